"""Queries of scalar functions: for each, a table, its key, and pairs of a Spark column and the SQL of the oracle.

Columns are built when a query runs, as they need a session.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dialect as d

P = ("part", "p_partkey")
C = ("customer", "c_custkey")
O = ("orders", "o_orderkey")  # noqa: E741
L = ("lineitem", "l_orderkey", "l_linenumber")
E = ("events", "event_id")
V = ("embeddings", "vec_id")


def long(x):
    return x.cast("long")


def scalars() -> dict[str, tuple[tuple[str, ...], dict[str, tuple]]]:
    def name():
        return F.col("p_name")

    def words():
        return F.split("p_name", " ")

    def odd():
        return F.when(F.col("p_partkey") % 3 == 0, None).otherwise(F.col("p_size"))

    def day():
        return F.col("o_orderdate").cast("date")

    def ts():
        return F.col("ts")

    def sizes():
        return F.array(F.col("p_size") % 5, F.col("p_size") % 3, odd(), F.col("p_size") % 5)

    def few():
        return F.array(F.lit(0), F.lit(2), F.lit(4))

    def js():
        return F.col("props")

    odd_sql = "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END"
    sizes_sql = f"[p_size % 5, p_size % 3, {odd_sql}, p_size % 5]"
    return {
        "str_01_concat": (P, {"skip": (lambda: d.concat_skip("p_name", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")), F.lit("!")), "concat(p_name, CASE WHEN p_partkey % 2 = 0 THEN p_brand END, '!')"), "pipes": (lambda: F.concat("p_name", F.lit("/"), "p_brand"), "p_name || '/' || p_brand")}),
        "str_02_concat_ws": (P, {"r": (lambda: F.concat_ws("-", "p_name", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")), "p_type"), "concat_ws('-', p_name, CASE WHEN p_partkey % 2 = 0 THEN p_brand END, p_type)")}),
        "str_03_length": (C, {"n": (lambda: long(F.length("c_name")), "length(c_name)"), "m": (lambda: long(F.length("c_mktsegment")), "len(c_mktsegment)")}),
        "str_04_case": (P, {"up": (lambda: F.upper("p_name"), "upper(p_name)"), "low": (lambda: F.lower("p_brand"), "lower(p_brand)")}),
        "str_05_trim": (P, {k: (lambda f=f: f(F.concat(F.lit("  "), "p_name", F.lit("   "))), f"{k}('  ' || p_name || '   ')") for k, f in (("trim", F.trim), ("ltrim", F.ltrim), ("rtrim", F.rtrim))}),
        "str_06_pad": (P, {"l": (lambda: F.lpad(F.col("p_size").cast("string"), 5, "0"), "lpad(CAST(p_size AS VARCHAR), 5, '0')"), "r": (lambda: F.rpad("p_brand", 12, "."), "rpad(p_brand, 12, '.')")}),
        "str_07_left_right": (P, {"l": (lambda: d.left("p_name", 4), "left(p_name, 4)"), "r": (lambda: d.right("p_name", 3), "right(p_name, 3)"), "ln": (lambda: d.left("p_name", -2), "left(p_name, -2)"), "rn": (lambda: d.right("p_name", -2), "right(p_name, -2)")}),
        "str_08_substr": (P, {"a": (lambda: d.substr("p_name", 2, 3), "substr(p_name, 2, 3)"), "b": (lambda: d.substr("p_name", 3), "substr(p_name, 3)"), "z": (lambda: d.substr("p_name", 0, 3), "substr(p_name, 0, 3)"), "n": (lambda: d.substr("p_name", -3, 2), "substr(p_name, -3, 2)")}),
        "str_09_replace": (P, {"r": (lambda: F.replace(name(), F.lit("a"), F.lit("_")), "replace(p_name, 'a', '_')")}),
        "str_10_split": (P, {"r": (lambda: F.array_join(d.split(F.concat("p_name", F.lit("|x|"), "p_brand"), "|"), ";"), "array_to_string(string_split(p_name || '|x|' || p_brand, '|'), ';')"), "n": (lambda: long(F.size(d.split("p_name", " "))), "len(string_split(p_name, ' '))")}),
        "str_11_split_part": (P, {f"p{n}".replace("-", "m"): (lambda n=n: d.split_part("p_name", " ", n), f"split_part(p_name, ' ', {n})") for n in (1, 2, 9, -1)}),
        "str_12_strtok": (P, {"a": (lambda: d.strtok("p_name", " ", 2), "split_part(p_name, ' ', 2)"), "b": (lambda: d.strtok("p_name", " "), "split_part(p_name, ' ', 1)")}),
        "str_13_reverse": (P, {"r": (lambda: F.reverse("p_name"), "reverse(p_name)")}),
        "str_14_repeat": (P, {"r": (lambda: F.repeat("p_brand", 3), "repeat(p_brand, 3)")}),
        "str_15_space": (P, {"r": (lambda: F.concat("p_brand", F.repeat(F.lit(" "), 3), "p_type"), "p_brand || repeat(' ', 3) || p_type")}),
        "str_16_initcap": (P, {"r": (lambda: F.initcap("p_name"), "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')")}),
        "str_18_translate": (P, {"r": (lambda: F.translate("p_name", "aei", "xy"), "translate(p_name, 'aei', 'xy')")}),
        "str_19_starts_ends": (P, {"s": (lambda: F.startswith(name(), F.lit("p")), "starts_with(p_name, 'p')"), "e": (lambda: F.endswith(name(), F.lit("1")), "ends_with(p_name, '1')")}),
        "str_20_contains": (P, {"r": (lambda: F.contains(name(), F.lit("ar")), "contains(p_name, 'ar')")}),
        "str_21_charindex": (P, {"a": (lambda: long(d.charindex("a", "p_name")), "strpos(p_name, 'a')"), "b": (lambda: long(d.charindex("r", "p_name", 3)), "CASE WHEN strpos(substr(p_name, 3), 'r') = 0 THEN 0 ELSE strpos(substr(p_name, 3), 'r') + 2 END")}),
        "str_22_position": (P, {"a": (lambda: long(F.instr("p_name", "t")), "instr(p_name, 't')"), "b": (lambda: long(F.position(F.lit("1"), name())), "position('1' IN p_name)")}),
        "str_23_ascii_chr": (P, {"a": (lambda: F.ascii("p_name"), "ascii(p_name)"), "c": (lambda: F.char(F.col("p_size") % 26 + 65), "chr(CAST(p_size % 26 + 65 AS INTEGER))")}),
        "str_24_unicode": (P, {"u": (lambda: d.unicode(F.concat(F.lit("é"), "p_name")), "unicode('é' || p_name)")}),
        "str_25_regexp_like": (P, {"full": (lambda: d.regexp_like("p_name", "[a-z ]+[0-9]*"), "regexp_full_match(p_name, '[a-z ]+[0-9]*')"), "rel_03_rlike": (lambda: F.rlike("p_name", F.lit("1[0-9]")), "regexp_matches(p_name, '1[0-9]')")}),
        "str_26_regexp_substr": (P, {"r": (lambda: d.regexp_substr("p_name", "[0-9]+"), "regexp_extract(p_name, '[0-9]+')")}),
        "str_27_regexp_replace": (P, {"first": (lambda: d.regexp_replace("p_name", "[aeiou]", "#"), "regexp_replace(p_name, '[aeiou]', '#')"), "all": (lambda: d.regexp_replace("p_name", "[aeiou]", "#", "g"), "regexp_replace(p_name, '[aeiou]', '#', 'g')"), "ref": (lambda: d.regexp_replace("p_name", "([a-z])([a-z])", "$2$1"), r"regexp_replace(p_name, '([a-z])([a-z])', '\2\1')")}),
        "str_28_regexp_count": (P, {"r": (lambda: long(F.regexp_count("p_name", F.lit("[aeiou]"))), "len(regexp_extract_all(p_name, '[aeiou]'))")}),
        "dt_02_parts": (O, {k: (lambda f=f: long(f("o_orderdate")), f"{s}(o_orderdate)") for k, f, s in (("y", F.year, "year"), ("m", F.month, "month"), ("dd", F.day, "day"), ("q", F.quarter, "quarter"), ("w", F.weekofyear, "week"), ("doy", F.dayofyear, "dayofyear"))}),
        "dt_03_dayofweek": (O, {"r": (lambda: long(d.dayofweek("o_orderdate")), "dayofweek(o_orderdate)")}),
        "dt_04_clock": (E, {"h": (lambda: long(F.hour("ts")), "hour(ts)"), "m": (lambda: long(F.minute("ts")), "minute(ts)"), "s": (lambda: long(F.second("ts")), "second(ts)")}),
        "dt_05_names": (O, {"d": (lambda: d.dayname("o_orderdate"), "dayname(o_orderdate)"), "m": (lambda: d.monthname("o_orderdate"), "monthname(o_orderdate)")}),
        "dt_06_extract": (O, {"a": (lambda: long(F.extract(F.lit("YEAR"), "o_orderdate")), "extract(year FROM o_orderdate)"), "b": (lambda: long(F.date_part(F.lit("MONTH"), "o_orderdate")), "date_part('month', o_orderdate)")}),
        "dt_07_date_trunc": (O, {u: (lambda u=u: F.date_trunc(u, "o_orderdate").cast("timestamp_ntz"), f"CAST(date_trunc('{u}', o_orderdate) AS TIMESTAMP)") for u in ("year", "quarter", "month", "week", "day")}),
        "dt_08_dateadd": (E, {u: (lambda u=u, n=n: d.dateadd(u, n, "ts"), f"ts + {n} * INTERVAL 1 {d.unit_of(u)}") for u, n in (("years", 1), ("month", 1), ("weeks", 2), ("day", -3), ("hours", 5), ("minute", 90), ("second", 61))}),
        "dt_09_datediff": (E, {u: (lambda u=u: d.datediff(u, "ts", F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")), f"date_diff('{u}', ts, TIMESTAMP '2024-03-01 00:00:00')") for u in ("year", "quarter", "month", "day", "hour", "minute", "second")}),
        "dt_09_datediff_week": (E, {"w": (lambda: d.datediff("week", "ts", F.lit("2024-03-01").cast("timestamp_ntz")), "CAST(trunc(date_diff('day', ts, TIMESTAMP '2024-03-01') / 7) AS BIGINT)")}),
        "dt_10_add_months": (O, {"r": (lambda: F.add_months(day(), 1), "CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE)")}),
        "dt_11_last_day": (O, {"r": (lambda: F.last_day(day()), "last_day(CAST(o_orderdate AS DATE))")}),
        "dt_12_next_previous_day": (O, {"n": (lambda: F.next_day(day(), "Fri"), "CAST(CAST(o_orderdate AS DATE) + CAST((4 - isodow(o_orderdate) + 7) % 7 + 1 AS INTEGER) AS DATE)"), "p": (lambda: d.previous_day(day(), "Fri"), "CAST(CAST(o_orderdate AS DATE) - CAST((isodow(o_orderdate) - 6 + 7) % 7 + 1 AS INTEGER) AS DATE)")}),
        "dt_13_months_between": (O, {"r": (lambda: F.months_between(F.last_day(F.add_months(day(), 3)), F.last_day(day())).cast("long"), "CAST(3 AS BIGINT)")}),
        "dt_14_date_from_parts": (O, {"r": (lambda: F.make_date(F.year(day()), F.month(day()), F.lit(1)), "make_date(year(o_orderdate), month(o_orderdate), 1)")}),
        "dt_16_timestamp_from_parts": (E, {"r": (lambda: F.make_timestamp_ntz(F.year(ts()), F.month(ts()), F.lit(2), F.hour(ts()), F.lit(3), F.lit(4)), "make_timestamp(year(ts), month(ts), 2, hour(ts), 3, 4)")}),
        "dt_17_convert_timezone": (E, {"r": (lambda: d.convert_timezone("UTC", "America/New_York", ts()), "ts - INTERVAL 5 HOUR")}),
        "dt_18_time_slice": (E, {"m": (lambda: d.time_slice("ts", 15, "minutes"), "time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01')"), "h": (lambda: d.time_slice("ts", 4, "hour"), "time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01')"), "mo": (lambda: d.time_slice("ts", 2, "month"), "time_bucket(INTERVAL 2 MONTH, ts, TIMESTAMP '1970-01-01')")}),
        "dt_19_to_date": (O, {"d": (lambda: F.to_date(F.date_format("o_orderdate", "yyyy-MM-dd")), "CAST(strftime(o_orderdate, '%Y-%m-%d') AS DATE)"), "t": (lambda: F.to_timestamp(F.date_format("o_orderdate", "dd/MM/yyyy"), "dd/MM/yyyy").cast("timestamp_ntz"), "strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y')")}),
        "num_01_abs_ceil_floor": (C, {"a": (lambda: F.abs("c_acctbal"), "abs(c_acctbal)"), "c": (lambda: F.ceil("c_acctbal").cast("double"), "ceil(c_acctbal)"), "f": (lambda: F.floor("c_acctbal").cast("double"), "floor(c_acctbal)")}),
        "num_02_round": (C, {"r": (lambda: F.round(F.col("c_acctbal").cast("decimal(18,2)"), 1), "round(CAST(c_acctbal AS DECIMAL(18,2)), 1)"), "z": (lambda: F.round("c_acctbal", 0), "round(c_acctbal, 0)")}),
        "num_03_trunc": (C, {"r": (lambda: d.trunc("c_acctbal"), "trunc(c_acctbal)")}),
        "num_04_mod": (P, {"r": (lambda: d.mod(-F.col("p_size"), F.lit(7)), "(-p_size) % 7"), "z": (lambda: d.mod("p_size", F.col("p_size") * 0), "CASE WHEN p_size IS NOT NULL THEN NULL ELSE 0 END")}),
        "num_05_powers": (P, {"s": (lambda: F.round(F.sqrt("p_retailprice"), 6), "round(sqrt(p_retailprice), 6)"), "p": (lambda: F.round(F.pow("p_size", F.lit(2)), 6), "round(power(p_size, 2), 6)"), "e": (lambda: F.round(F.exp(F.col("p_size") / 50), 6), "round(exp(p_size / 50), 6)"), "l": (lambda: F.round(F.ln("p_retailprice"), 6), "round(ln(p_retailprice), 6)")}),
        "num_06_log": (P, {"b": (lambda: F.round(F.log(10.0, F.col("p_retailprice")), 6), "round(log10(p_retailprice), 6)"), "t": (lambda: F.round(F.log10("p_retailprice"), 6), "round(log10(p_retailprice), 6)"), "two": (lambda: F.round(F.log(2.0, F.col("p_retailprice")), 6), "round(log2(p_retailprice), 6)")}),
        "num_07_sign": (C, {"r": (lambda: d.sign("c_acctbal"), "CAST(sign(c_acctbal) AS INTEGER)")}),
        "num_08_more": (P, {"c": (lambda: F.round(F.cbrt("p_retailprice"), 6), "round(cbrt(p_retailprice), 6)"), "f": (lambda: F.factorial(F.col("p_size") % 10), "CAST(factorial(CAST(p_size % 10 AS INTEGER)) AS BIGINT)"), "d": (lambda: F.round(F.degrees("p_size"), 6), "round(degrees(p_size), 6)"), "r": (lambda: F.round(F.radians("p_size"), 6), "round(radians(p_size), 6)"), "pi": (lambda: F.round(F.pi(), 6), "round(pi(), 6)")}),
        "num_09_greatest_least": (P, {"g": (lambda: F.greatest("p_size", F.lit(20), odd()), f"greatest(p_size, 20, {odd_sql})"), "l": (lambda: F.least("p_size", F.lit(20), odd()), f"least(p_size, 20, {odd_sql})")}),
        "num_10_div0": (P, {"r": (lambda: F.round(d.div0("p_retailprice", F.col("p_size") % 3), 6), "CASE WHEN p_size % 3 = 0 THEN 0 ELSE round(p_retailprice / (p_size % 3), 6) END")}),
        "num_11_div0null": (P, {"r": (lambda: F.round(d.div0null("p_retailprice", F.col("p_size") % 3), 6), "CASE WHEN p_size % 3 = 0 THEN NULL ELSE round(p_retailprice / (p_size % 3), 6) END")}),
        "num_12_width_bucket": (P, {"r": (lambda: F.width_bucket(F.col("p_size").cast("double"), F.lit(10.0), F.lit(40.0), F.lit(6)), "CAST(CASE WHEN p_size < 10 THEN 0 WHEN p_size >= 40 THEN 7 ELSE floor((p_size - 10) * 6 / 30.0) + 1 END AS BIGINT)")}),
        "num_15_bits": (P, {"a": (lambda: F.col("p_size").bitwiseAND(12), "p_size & 12"), "o": (lambda: F.col("p_size").bitwiseOR(12), "p_size | 12"), "x": (lambda: F.col("p_size").bitwiseXOR(12), "xor(p_size, 12)"), "n": (lambda: F.bitwise_not("p_size"), "~p_size")}),
        "num_16_division": (P, {"r": (lambda: F.round(F.try_divide("p_size", F.lit(4)), 6), "round(p_size / 4, 6)"), "z": (lambda: F.try_divide("p_size", F.lit(0)), "CAST(NULL AS DOUBLE)")}),
        "cond_01_iff": (P, {"r": (lambda: d.iff(odd() > 20, F.lit("big"), F.lit("small")), f"CASE WHEN {odd_sql} > 20 THEN 'big' ELSE 'small' END")}),
        "cond_02_nvl": (P, {"a": (lambda: F.nvl(odd(), F.lit(-1)), f"coalesce({odd_sql}, -1)"), "b": (lambda: F.ifnull(odd(), F.lit(-2)), f"ifnull({odd_sql}, -2)")}),
        "cond_03_nvl2": (P, {"r": (lambda: F.nvl2(odd(), F.lit("y"), F.lit("n")), f"CASE WHEN {odd_sql} IS NOT NULL THEN 'y' ELSE 'n' END")}),
        "cond_04_zeroifnull": (P, {"z": (lambda: F.zeroifnull(odd()), f"coalesce({odd_sql}, 0)"), "n": (lambda: F.nullifzero(F.col("p_size") % 4), "nullif(p_size % 4, 0)")}),
        "cond_05_coalesce_nullif": (P, {"c": (lambda: F.coalesce(odd(), F.col("p_partkey") * 0 - 5), f"CAST(coalesce({odd_sql}, -5) AS BIGINT)"), "n": (lambda: F.nullif("p_size", F.lit(7)), "nullif(p_size, 7)")}),
        "cond_06_decode": (P, {"r": (lambda: d.decode(odd(), 1, "one", 2, "two", None, "none", "other"), f"CASE WHEN ({odd_sql}) IS NOT DISTINCT FROM 1 THEN 'one' WHEN ({odd_sql}) IS NOT DISTINCT FROM 2 THEN 'two' WHEN ({odd_sql}) IS NULL THEN 'none' ELSE 'other' END"), "n": (lambda: d.decode("p_size", 1, "one"), "CASE WHEN p_size = 1 THEN 'one' END")}),
        "cond_07_case": (P, {"r": (lambda: F.when(F.col("p_size") < 10, "s").when(F.col("p_size") < 30, "m").otherwise("l"), "CASE WHEN p_size < 10 THEN 's' WHEN p_size < 30 THEN 'm' ELSE 'l' END")}),
        "cond_08_equal_null": (P, {"r": (lambda: F.equal_null(odd(), F.nullif("p_size", F.lit(9))), f"({odd_sql}) IS NOT DISTINCT FROM nullif(p_size, 9)")}),
        "cond_09_bool": (P, {"a": (lambda: d.booland(F.col("p_size") % 2, F.col("p_size") % 3), "(p_size % 2 <> 0) AND (p_size % 3 <> 0)"), "o": (lambda: d.boolor(F.col("p_size") % 2, F.col("p_size") % 3), "(p_size % 2 <> 0) OR (p_size % 3 <> 0)"), "x": (lambda: d.boolxor(F.col("p_size") % 2, F.col("p_size") % 3), "(p_size % 2 <> 0) <> (p_size % 3 <> 0)"), "n": (lambda: d.boolnot(F.col("p_size") % 2), "p_size % 2 = 0")}),
        "conv_01_cast": (C, {"i": (lambda: d.to_integer(F.floor("c_acctbal") + 0.5), "CAST(floor(c_acctbal) + 0.5 AS BIGINT)"), "s": (lambda: F.col("c_custkey").cast("string"), "CAST(c_custkey AS VARCHAR)"), "d": (lambda: F.col("c_acctbal").cast("decimal(18,2)"), "CAST(c_acctbal AS DECIMAL(18,2))")}),
        "conv_02_try_cast": (P, {"a": (lambda: d.split_part("p_name", " ", -1).try_cast("double"), "TRY_CAST(split_part(p_name, ' ', -1) AS DOUBLE)"), "b": (lambda: F.col("p_brand").try_cast("int"), "TRY_CAST(p_brand AS INTEGER)")}),
        "conv_03_to_char": (O, {"a": (lambda: F.col("o_orderkey").cast("string"), "CAST(o_orderkey AS VARCHAR)"), "d": (lambda: F.date_format("o_orderdate", "yyyy/MM/dd"), "strftime(o_orderdate, '%Y/%m/%d')")}),
        "conv_04_to_number": (P, {"r": (lambda: d.to_number(F.concat(F.col("p_size").cast("string"), F.lit(".45")), 12, 2), "CAST(CAST(p_size AS VARCHAR) || '.45' AS DECIMAL(12,2))")}),
        "conv_05_to_double": (P, {"r": (lambda: F.concat(F.col("p_size").cast("string"), F.lit(".5")).cast("double"), "CAST(CAST(p_size AS VARCHAR) || '.5' AS DOUBLE)")}),
        "conv_06_to_boolean": (P, {"r": (lambda: F.when(F.col("p_size") % 2 == 0, "true").otherwise("no").cast("boolean"), "CASE WHEN p_size % 2 = 0 THEN true ELSE false END")}),
        "conv_07_try_to_number": (P, {"r": (lambda: d.try_to_number("p_brand"), "TRY_CAST(p_brand AS DOUBLE)"), "s": (lambda: d.try_to_number(F.col("p_size").cast("string")), "CAST(p_size AS DOUBLE)")}),
        "conv_08_try_to_decimal": (P, {"r": (lambda: d.try_to_decimal(F.concat(F.col("p_size").cast("string"), F.lit(".25")), 10, 2), "TRY_CAST(CAST(p_size AS VARCHAR) || '.25' AS DECIMAL(10,2))")}),
        "conv_09_try_to_date": (P, {"d": (lambda: F.col("p_brand").try_cast("date"), "TRY_CAST(p_brand AS DATE)"), "b": (lambda: F.col("p_brand").try_cast("boolean"), "TRY_CAST(p_brand AS BOOLEAN)"), "t": (lambda: F.concat(F.lit("2024-01-0"), (F.col("p_size") % 9 + 1).cast("string")).try_cast("timestamp_ntz"), "TRY_CAST('2024-01-0' || CAST(p_size % 9 + 1 AS VARCHAR) AS TIMESTAMP)")}),
        "conv_10_typeof": (P, {"i": (lambda: d.typeof("p_size"), "typeof(p_size)"), "s": (lambda: d.typeof("p_name"), "typeof(p_name)"), "b": (lambda: d.typeof("p_partkey"), "typeof(p_partkey)"), "d": (lambda: d.typeof("p_retailprice"), "typeof(p_retailprice)")}),
        "arr_01_02_construct_size": (P, {"n": (lambda: long(F.array_size(sizes())), f"len({sizes_sql})"), "j": (lambda: F.array_join(sizes(), ","), f"array_to_string({sizes_sql}, ',')"), "z": (lambda: long(F.array_size(F.when(odd().isNotNull(), words()))), f"CASE WHEN {odd_sql} IS NOT NULL THEN len(string_split(p_name, ' ')) END")}),
        "arr_03_contains": (P, {"r": (lambda: F.coalesce(d.array_contains(2, F.array_compact(sizes())), F.lit(False)), f"list_contains({sizes_sql}, 2)")}),
        "arr_04_position": (P, {"r": (lambda: long(d.array_position(2, sizes())), f"list_position({sizes_sql}, 2) - 1")}),
        "arr_05_get": (P, {"r": (lambda: F.get(words(), F.lit(1)), "string_split(p_name, ' ')[2]"), "o": (lambda: F.get(words(), F.lit(99)), "string_split(p_name, ' ')[100]")}),
        "arr_06_slice": (P, {"r": (lambda: F.array_join(d.array_slice(sizes(), 1, 3), ",", "?"), f"array_to_string(list_transform({sizes_sql}[2:4], lambda x: coalesce(CAST(x AS VARCHAR), '?')), ',')")}),
        "arr_07_cat": (P, {"r": (lambda: F.array_join(F.concat(words(), F.array(F.col("p_brand"))), ","), "array_to_string(list_concat(string_split(p_name, ' '), [p_brand]), ',')")}),
        "arr_08_09_append_prepend": (P, {"a": (lambda: F.array_join(F.array_append(words(), F.col("p_brand")), ","), "array_to_string(list_append(string_split(p_name, ' '), p_brand), ',')"), "p": (lambda: F.array_join(F.array_prepend(words(), F.col("p_brand")), ","), "array_to_string(list_prepend(p_brand, string_split(p_name, ' ')), ',')")}),
        "arr_10_11_sort_reverse": (P, {"s": (lambda: F.array_join(F.array_sort(words()), ","), "array_to_string(list_sort(string_split(p_name, ' ')), ',')"), "r": (lambda: F.array_join(F.reverse(words()), ","), "array_to_string(list_reverse(string_split(p_name, ' ')), ',')")}),
        "arr_12_min_max": (P, {"a": (lambda: F.array_min(sizes()), f"list_min({sizes_sql})"), "b": (lambda: F.array_max(sizes()), f"list_max({sizes_sql})")}),
        "arr_13_sum_avg": (V, {"s": (lambda: F.round(d.array_sum("embedding"), 4), "round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4)"), "a": (lambda: F.round(d.array_avg("embedding"), 5), "round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5)")}),
        "arr_14_overlap": (P, {"r": (lambda: d.arrays_overlap(sizes(), F.array(F.lit(4))), f"list_has_any({sizes_sql}, [4])")}),
        "arr_15_distinct": (P, {"r": (lambda: F.array_join(F.array_sort(d.array_distinct(sizes())), ","), f"array_to_string(list_sort(list_distinct({sizes_sql})), ',')")}),
        "arr_16_17_sets": (P, {"i": (lambda: F.array_join(d.array_intersection(F.array_compact(sizes()), few()), ","), f"array_to_string(list_filter({sizes_sql}, lambda x: list_contains([0, 2, 4], x)), ',')"), "e": (lambda: F.array_join(d.array_except(F.array_compact(sizes()), few()), ","), f"array_to_string(list_filter({sizes_sql}, lambda x: x IS NOT NULL AND NOT list_contains([0, 2, 4], x)), ',')")}),
        "arr_18_compact": (P, {"r": (lambda: F.array_join(F.array_compact(sizes()), ","), f"array_to_string(list_filter({sizes_sql}, lambda x: x IS NOT NULL), ',')")}),
        "arr_19_to_string": (P, {"r": (lambda: F.array_join(sizes(), "-"), f"array_to_string({sizes_sql}, '-')")}),
        "json_01_02_parse": (E, {"ok": (lambda: d.is_json("props"), "json_valid(props)"), "bad": (lambda: ~d.is_json(F.concat(js(), F.lit("}"))), "NOT json_valid(props || '}')")}),
        "json_03_04_construct": (P, {"r": (lambda: d.object_construct(a="p_size", b=odd(), c="p_brand"), f"CAST(json_object('a', p_size, 'b', {odd_sql}, 'c', p_brand) AS VARCHAR)")}),
        "json_05_06_insert_delete": (E, {"i": (lambda: F.get_json_object(d.object_insert("props", "z", F.lit(5)), "$.z"), "'5'"), "k": (lambda: F.get_json_object(d.object_insert("props", "z", F.lit(5)), "$.k"), "props ->> '$.k'"), "x": (lambda: d.object_delete("props", "k"), "'{}'")}),
        "json_07_keys": (E, {"r": (lambda: F.array_join(d.object_keys("props"), ","), "array_to_string(json_keys(props), ',')")}),
        "json_08_09_path": (E, {"k": (lambda: d.get_path("props", "k"), "props ->> '$.k'"), "n": (lambda: d.get_path(F.concat(F.lit('{"a":{"b":[0,'), js(), F.lit("]}}")), "a.b[1].k"), "props ->> '$.k'"), "none": (lambda: d.get_path("props", "x.y"), "props ->> '$.x.y'")}),
        "json_10_extract_text": (E, {"r": (lambda: d.json_extract_path_text(F.concat(F.lit('{"a":'), js(), F.lit("}")), "a", "k"), "props ->> '$.k'")}),
        "json_11_to_json": (P, {"r": (lambda: F.to_json(F.array("p_brand", "p_type")), "CAST(to_json([p_brand, p_type]) AS VARCHAR)")}),
        "json_12_check": (E, {"ok": (lambda: d.check_json("props"), "CASE WHEN json_valid(props) THEN NULL ELSE 'Invalid JSON' END"), "bad": (lambda: d.check_json(F.concat(js(), F.lit("]"))), "'Invalid JSON'")}),
        "hash_01_02_03_digests": (P, {"m": (lambda: F.md5("p_name"), "md5(p_name)"), "s": (lambda: F.sha1("p_name"), "sha1(p_name)"), "t": (lambda: F.sha2("p_name", 256), "sha256(p_name)")}),
        "hash_05_md5_number": (P, {"l": (lambda: d.md5_number_lower64("p_name").cast("decimal(20,0)"), "CAST(CAST(('0x' || substr(md5(p_name), 17, 16)) AS UBIGINT) AS DECIMAL(20,0))")}),
        "hash_06_base64": (P, {"e": (lambda: F.base64(F.col("p_name").cast("binary")), "base64(encode(p_name))"), "d": (lambda: d.base64_decode_string(F.base64(F.col("p_name").cast("binary"))), "p_name"), "t": (lambda: d.try_base64_decode_string(F.lit("%%%")), "CAST(NULL AS VARCHAR)")}),
        "hash_07_hex": (P, {"e": (lambda: F.hex(F.col("p_name").cast("binary")), "hex(p_name)"), "d": (lambda: d.hex_decode_string(F.hex(F.col("p_name").cast("binary"))), "p_name")}),
    }


def queries() -> dict:
    def make(name: str):
        def query(spark, sf_dir):
            (table, *keys), pairs = scalars()[name]
            return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*keys, *[pair[0]().alias(alias) for alias, pair in pairs.items()])

        query.__name__ = name
        return query

    return {name: make(name) for name in scalars()}


def oracle_sql() -> dict[str, str]:
    return {name: f"SELECT {', '.join(table[1:])}, {', '.join(f'{pair[1]} AS {chr(34)}{alias}{chr(34)}' for alias, pair in pairs.items())} FROM {table[0]}" for name, (table, pairs) in scalars().items()}
