"""The query catalogue: each entry runs an operator on a driver table, with the same question in SQL where SQL can ask it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import encode
from .operators import commit, index, metrics, ordered, profile, search, security, templates
from .plans import archive, detect
from .sources import binary, formats, generate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- search -------------------------------------------------------------


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE contains(event_type, 'error') OR contains(props, 'error')")
def search_any_column(spark, d):
    return search.search(table(spark, d, "events"), "error")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey = 42 OR o_custkey = 42 OR o_orderstatus = '42' OR o_orderpriority = '42'")
def search_compat_modes(spark, d):
    orders = table(spark, d, "orders")
    modes = {r["column"]: r["mode"] for r in profile.encoding_profile(orders).collect()}  # one row per column
    return search.search(orders, "42", "compat", "o_orderkey", modes)


@query("SELECT p_partkey FROM part WHERE p_partkey = 24 OR p_size = 24 OR contains(p_name, '24') OR contains(p_brand, '24') OR contains(p_type, '24') OR p_retailprice = 24.0 ORDER BY p_partkey")
def search_int(spark, d):
    return search.search(table(spark, d, "part"), "24", "contains", "p_partkey")


@query("SELECT c_custkey, c_name FROM customer WHERE regexp_extract(c_name, '^(.*?)([0-9]+)$', 1) = 'Customer#' AND CAST(regexp_extract(c_name, '^(.*?)([0-9]+)$', 2) AS BIGINT) = 42")
def search_numeric_suffix(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_name")
    return customer.where(search.compat_test(F.col("c_name"), "string", "Customer#42", "suffix")[0])


@query("SELECT event_id, event_type FROM events WHERE date_trunc('second', ts) = (SELECT date_trunc('second', ts) FROM events WHERE event_id = 5)")
def search_iso_second(spark, d):
    events = table(spark, d, "events")
    second = events.where("event_id = 5").select(F.date_trunc("second", "ts").alias("s"))  # one row
    return events.withColumn("s", F.date_trunc("second", "ts")).join(F.broadcast(second), "s", "left_semi").select("event_id", "event_type")


@query("SELECT doc_id, source FROM documents WHERE contains(text, 'License')")
def search_substring(spark, d):
    return table(spark, d, "documents").where(F.col("text").contains("License")).select("doc_id", "source")


@query("SELECT vec_id, label FROM embeddings WHERE label = 3")
def single_column_grep(spark, d):
    return search.where(table(spark, d, "embeddings").select("vec_id", "label"), "label=3")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'purchase'")
def filter_field(spark, d):
    return search.where(table(spark, d, "events"), "event_type=purchase").select("event_id", "event_type")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000.5")
def filter_range(spark, d):
    return search.where(table(spark, d, "orders"), "o_totalprice > 250000.5").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def filter_time_range(spark, d):
    return search.where(table(spark, d, "orders"), "o_orderdate >= 1998-01-01").select("o_orderkey")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '/en/[0-9]+')")
def filter_regex(spark, d):
    return search.where(table(spark, d, "pages").select("page_id", "url"), "url ~ /en/[0-9]+")


LINES = "(SELECT doc_id, pos AS line_no, string_split(text, chr(10))[pos] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents))"


@query(f"SELECT doc_id, line_no, line FROM {LINES} WHERE contains(lower(line), 'license') ORDER BY doc_id, line_no LIMIT 100")
def grep_ci_limit(spark, d):
    return search.grep(table(spark, d, "documents"), "doc_id", "text", "license", limit=100)


@query("SELECT source, CAST(sum((length(text) - length(replace(text, 'the', ''))) / 3) AS BIGINT) AS hits FROM documents GROUP BY source")
def count_occurrences(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.sum(search.occurrences(F.col("text"), "the")).alias("hits"))


@query(f"SELECT doc_id, line_no, line, contains(line, 'License') AS hit FROM (SELECT *, max(contains(line, 'License')) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM {LINES}) WHERE near")
def grep_context(spark, d):
    return search.grep_context(table(spark, d, "documents"), "doc_id", "text", "License", 2)


@query(f"SELECT count(*) AS n, sum(line_no) AS offsets FROM {LINES} WHERE contains(line, 'License')")
def grep_json(spark, d):
    found = search.matches_json(table(spark, d, "documents"), "doc_id", "text", "License")
    return found.select(F.get_json_object("json", "$.offset").cast("long").alias("o")).agg(F.count(F.lit(1)).alias("n"), F.sum("o").alias("offsets"))


@query("SELECT count(*) FILTER (f AND t) AS true_positive, count(*) FILTER (f AND NOT t) AS false_positive, count(*) FILTER (t AND NOT f) AS false_negative, count(*) FILTER (f <> t) = 0 AS exact FROM (SELECT coalesce(event_id = 7 OR user_id = 7 OR contains(event_type, '7') OR contains(props, '7') OR value = 7, false) AS f, user_id = 7 AS t FROM events)")
def grep_quality(spark, d):
    events = table(spark, d, "events")
    return search.quality(search.search(events, "7"), events.where("user_id = 7"), "event_id")


# --- columns and encodings ------------------------------------------------

ZONES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}


def _zone_sql(c: str, kind: str) -> str:
    own = {"bigint": "long", "int": "long", "double": "double"}.get(kind, "text")
    bounds = ", ".join(f"{f'CAST({side}({c}) AS {sql})' if form == own else f'CAST(NULL AS {sql})'} AS {name}_{form}" for form, sql in (("long", "BIGINT"), ("double", "DOUBLE"), ("text", "VARCHAR")) for name, side in (("low", "min"), ("high", "max")))
    return f"SELECT '{c}' AS \"column\", '{kind}' AS type, count(*) AS n, count(*) - count({c}) AS nulls, {bounds} FROM lineitem"


@query(" UNION ALL ".join(_zone_sql(c, k) for c, k in ZONES.items()))
def zone_map(spark, d):
    return profile.zone_map(table(spark, d, "lineitem"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, count(DISTINCT {c}) AS \"distinct\", min({c}) = max({c}) AS constant FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
def cardinality_profile(spark, d):
    return profile.cardinality(table(spark, d, "customer"))


def _dict_mode(c: str) -> str:
    numbered = f"count({c}) >= 8 AND count(*) FILTER (regexp_matches({c}, '[0-9]$')) = count({c}) AND min(regexp_extract({c}, '{encode.SUFFIX}', 1)) = max(regexp_extract({c}, '{encode.SUFFIX}', 1)) AND max(TRY_CAST(regexp_extract({c}, '{encode.SUFFIX}', 2) AS BIGINT)) - min(TRY_CAST(regexp_extract({c}, '{encode.SUFFIX}', 2) AS BIGINT)) = count({c}) - 1 AND count(DISTINCT {c}) = count({c})"
    return f"CASE WHEN count({c}) = 0 THEN 'empty' WHEN {numbered} THEN 'suffix' WHEN min(CAST(regexp_matches({c}, '{encode.ISO}') AS INT)) = 1 THEN 'iso' WHEN count(DISTINCT {c}) < 256 AND count({c}) > 10 THEN 'dict1' WHEN count(DISTINCT {c}) < 65536 AND count({c}) > 10 THEN 'dict2' ELSE 'raw' END"


@query(" UNION ALL ".join([f"SELECT '{c}' AS \"column\", {m} AS mode FROM customer" for c, m in (("c_custkey", "CASE WHEN count(c_custkey) = 0 THEN 'empty' ELSE 'delta_int' END"), ("c_name", _dict_mode("c_name")), ("c_nationkey", "CASE WHEN count(c_nationkey) = 0 THEN 'empty' ELSE 'delta_int' END"), ("c_acctbal", "CASE WHEN count(c_acctbal) = 0 THEN 'empty' ELSE 'float64' END"), ("c_mktsegment", _dict_mode("c_mktsegment")))]))
def encoding_profile(spark, d):
    return profile.encoding_profile(table(spark, d, "customer"))


@query("SELECT count(*) AS n, count(v) AS present, count(*) - count(v) AS absent FROM (SELECT CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events)")
def null_mask(spark, d):
    v = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return table(spark, d, "events").select(encode.null_mask(v).alias("m")).agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("present"), F.sum(1 - F.col("m")).alias("absent"))


@query("SELECT l_returnflag AS value, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS id, n FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)")
def dict_encode(spark, d):
    flags = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    values = flags.agg(F.array_sort(F.collect_set("value")).alias("all"))  # the dictionary: under 256 values by the encoding's own rule
    return flags.join(values).select("value", (F.array_position("all", F.col("value")) - 1).alias("id"), "n")


@query("SELECT count(*) AS n, count(*) FILTER (value <> back OR back IS NULL) AS differing FROM (SELECT l.l_returnflag AS value, dic.v AS back FROM lineitem l LEFT JOIN (SELECT l_returnflag AS v FROM lineitem GROUP BY 1) dic ON l.l_returnflag = dic.v)")
def dict_decode(spark, d):
    dictionary = dict_encode(spark, d).select("value", "id")
    coded = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("value")).join(dictionary, "value")
    back = coded.join(dictionary.select(F.col("value").alias("back"), "id"), "id", "left")
    return back.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("value").eqNullSafe(F.col("back")), 1)).alias("differing"))


@query("SELECT o_orderkey, o_custkey - lag(o_custkey, 1, 0) OVER (ORDER BY o_orderkey) AS delta FROM orders")
def delta_encode(spark, d):
    rows = ordered.with_previous(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", F.col("o_custkey"), "last", default=0)
    return rows.select("o_orderkey", (F.col("o_custkey") - F.col("last")).alias("delta"))


@query("SELECT CASE WHEN min(delta) >= -128 AND max(delta) < 128 THEN 1 WHEN min(delta) >= -32768 AND max(delta) < 32768 THEN 2 WHEN min(delta) >= -2147483648 AND max(delta) < 2147483648 THEN 4 ELSE 8 END AS width FROM (SELECT o_custkey - lag(o_custkey, 1, 0) OVER (ORDER BY o_orderkey) AS delta FROM orders)")
def delta_width(spark, d):
    return delta_encode(spark, d).agg(encode.delta_width(F.min("delta"), F.max("delta")).alias("width"))


@query("SELECT o_orderkey, o_custkey AS restored FROM orders")
def delta_roundtrip(spark, d):
    return ordered.with_running_sum(delta_encode(spark, d), "o_orderkey", F.col("delta"), "restored").select("o_orderkey", "restored")


@query("SELECT l_orderkey, l_linenumber, z, CASE WHEN z < 128 THEN 1 WHEN z < 16384 THEN 2 WHEN z < 2097152 THEN 3 ELSE 4 END AS n_bytes FROM (SELECT l_orderkey, l_linenumber, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS z FROM (SELECT l_orderkey, l_linenumber, l_partkey - l_orderkey AS v FROM lineitem))")
def zigzag_varint_len(spark, d):
    z = encode.zigzag(F.col("l_partkey") - F.col("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", z.alias("z"), encode.varint_bytes(z).alias("n_bytes"))


@query("SELECT min(regexp_matches(replace(CAST(ts AS VARCHAR), ' ', 'T'), '" + encode.ISO + "')) AS ts_is_iso, min(regexp_matches(event_type, '" + encode.ISO + "')) AS type_is_iso FROM events")
def iso_detect(spark, d):
    return table(spark, d, "events").agg(F.min(encode.is_iso(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))).alias("ts_is_iso"), F.min(encode.is_iso(F.col("event_type"))).alias("type_is_iso"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events")
def iso_seconds(spark, d):
    return table(spark, d, "events").select("event_id", encode.iso_seconds(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).alias("seconds"))


@query(f"SELECT regexp_extract(c_name, '{encode.SUFFIX}', 1) AS prefix, count(*) AS n, min(CAST(regexp_extract(c_name, '{encode.SUFFIX}', 2) AS BIGINT)) AS low, max(CAST(regexp_extract(c_name, '{encode.SUFFIX}', 2) AS BIGINT)) AS high FROM customer GROUP BY 1")
def suffix_detect(spark, d):
    rows = table(spark, d, "customer").select(encode.suffix_parts(F.col("c_name")).alias("s"))
    return rows.groupBy(F.col("s.prefix").alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("s.digits").cast("long")).alias("low"), F.max(F.col("s.digits").cast("long")).alias("high"))


@query("SELECT max(c_custkey) - min(c_custkey) = count(*) - 1 AND count(DISTINCT c_custkey) = count(*) AS sequential FROM customer")
def sequential_run(spark, d):
    return table(spark, d, "customer").agg(((F.max("c_custkey") - F.min("c_custkey") == F.count(F.lit(1)) - 1) & (F.countDistinct("c_custkey") == F.count(F.lit(1)))).alias("sequential"))


@query("SELECT c_custkey, '10.' || ((c_custkey // 65536) % 256) || '.' || ((c_custkey // 256) % 256) || '.' || (c_custkey % 256) AS ip, 167772160 + c_custkey % 16777216 AS packed, true AS same FROM customer")
def ipv4_pack(spark, d):
    octet = lambda s: F.floor(F.col("c_custkey") / (1 << s)).cast("long") % 256
    ip = F.concat_ws(".", F.lit("10"), octet(16).cast("string"), octet(8).cast("string"), octet(0).cast("string"))
    rows = table(spark, d, "customer").select("c_custkey", ip.alias("ip")).withColumn("packed", encode.ipv4_to_long(F.col("ip")))
    return rows.withColumn("same", encode.long_to_ipv4(F.col("packed")) == F.col("ip"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def json_shred(spark, d):
    rows = table(spark, d, "events").select(F.from_json("props", "k long")["k"].alias("k"), "value")
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


BAD_LINES = ['{"a": 1}', '{"a": 2', "[1, 2]", "7", "", "  ", '{"b": null}', "not json"]


@query("SELECT good + n AS good, bad FROM (SELECT 2 AS good, 4 AS bad), (SELECT count(*) AS n FROM events)")
def json_malformed(spark, d):
    extra = spark.createDataFrame([(x,) for x in BAD_LINES], "props string")
    rows = formats.jsonl(table(spark, d, "events").select("props").unionByName(extra), "props", "k long, a long")
    return rows.agg(F.count(F.when(~F.col("bad"), 1)).alias("good"), F.count(F.when(F.col("bad"), 1)).alias("bad"))


@query("SELECT 'k' AS key, CAST(0 AS BIGINT) AS place UNION ALL SELECT 'extra', 1")
def key_order(spark, d):
    lines = table(spark, d, "events").select("event_id", F.when(F.col("event_id") == 3, '{"k": 1, "extra": 2}').otherwise(F.col("props")).alias("props"))
    return formats.key_order(lines, "props", "event_id")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def field_split(spark, d):
    return table(spark, d, "customer").drop("c_acctbal", "c_nationkey")


@query("SELECT vec_id, CAST(pos - 1 AS INT) AS place, round(CAST(embedding[pos] AS DOUBLE), 6) AS item FROM (SELECT vec_id, embedding, unnest(range(1, (SELECT max(len(embedding)) FROM embeddings) + 1)) AS pos FROM embeddings)")
def token_sequences(spark, d):
    vectors = table(spark, d, "embeddings")
    widest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    rows = vectors.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(widest - 1)), lambda k: F.coalesce(F.get("embedding", k).cast("double"), F.lit(-1.0)))).alias("place", "item"))
    return rows.withColumn("item", F.round("item", 6))


@query("SELECT doc_id, len(list_filter(regexp_extract_all(text, '[0-9a-fA-F]{16,}'), lambda t: length(t) % 2 = 0 AND (t = lower(t) OR t = upper(t)))) AS liftable, len(regexp_extract_all(text, '[0-9a-fA-F]{16,}')) AS hex FROM documents")
def hex_tokens(spark, d):
    found = encode.hex_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(found, encode.liftable_hex)).cast("long").alias("liftable"), F.size(found).cast("long").alias("hex"))


@query("SELECT c_custkey, b64 AS token, true AS liftable FROM (SELECT c_custkey, base64(encode(c_name)) AS b64 FROM customer)")
def base64_tokens(spark, d):
    token = F.base64(F.encode("c_name", "UTF-8"))
    return table(spark, d, "customer").select("c_custkey", token.alias("token"), encode.liftable_base64(token).alias("liftable"))


# --- templates, order -------------------------------------------------------

TEMPLATED = f"""(SELECT doc_id, line_no, line, regexp_replace(line, '"[^"]*"|[0-9]+', chr(7), 'g') AS template, regexp_extract_all(line, '"[^"]*"|[0-9]+') AS vars FROM {LINES})"""


def _templated(spark, d):
    return templates.with_template(search.lines(table(spark, d, "documents"), "doc_id", "text"))


@query(f"SELECT count(*) AS n_lines, count(DISTINCT template) AS n_templates, sum(len(vars)) AS n_variables FROM {TEMPLATED}")
def template_extract(spark, d):
    return _templated(spark, d).agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("template").alias("n_templates"), F.sum(F.size("variables")).alias("n_variables"))


@query(f"SELECT replace(template, chr(7), '<*>') AS template, count(*) AS n FROM {TEMPLATED} GROUP BY 1 ORDER BY n DESC, template LIMIT 20")
def template_topk(spark, d):
    shown = F.replace(F.col("template"), F.lit(templates.HOLE), F.lit("<*>"))
    return _templated(spark, d).groupBy(shown.alias("template")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "template").limit(20)


@query(f"SELECT CAST(pos - 1 AS INT) AS place, count(*) AS n, count(DISTINCT v) AS n_values FROM (SELECT pos, vars[pos] AS v FROM (SELECT vars, unnest(range(1, len(vars) + 1)) AS pos FROM {TEMPLATED})) GROUP BY 1")
def template_vars(spark, d):
    return templates.variable_rows(_templated(spark, d), ["doc_id", "line_no"]).groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"))


@query(f"SELECT count(*) AS n, 0 AS differing FROM {LINES}")
def template_render(spark, d):
    return _templated(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(templates.rendered() != F.col("line"), 1)).cast("int").alias("differing"))


@query(f"SELECT md5(replace(template, chr(7), '<*>')) AS digest, row_number() OVER (ORDER BY first_row) - 1 AS template_id, first_row, n FROM (SELECT template, min(doc_id * (SELECT max(line_no) + 1 FROM {TEMPLATED}) + line_no) AS first_row, count(*) AS n FROM {TEMPLATED} GROUP BY template)")
def template_dictionary(spark, d):
    longest = table(spark, d, "documents").agg(F.max(F.size(F.split("text", "\n", -1)))).first()[0] or 0
    rows = _templated(spark, d).withColumn("seq", F.col("doc_id") * (longest + 1) + F.col("line_no"))
    found = ordered.first_seen(rows, ["template"], "seq", "template_id")
    return found.select(F.md5(F.replace(F.col("template"), F.lit(templates.HOLE), F.lit("<*>"))).alias("digest"), "template_id", "first_row", "n")


@query("SELECT event_type, user_id, first_row, n, row_number() OVER (ORDER BY first_row) AS pattern_id FROM (SELECT event_type, user_id, min(event_id) AS first_row, count(*) AS n FROM events GROUP BY 1, 2)")
def pattern_dedup(spark, d):
    return ordered.first_seen(table(spark, d, "events"), ["event_type", "user_id"], "event_id", "pattern_id", start=1)


@query(f"SELECT count(*) AS n_lines, count(DISTINCT line) AS n_unique, count(*) - count(DISTINCT line) AS n_repeats, max(c) AS most FROM {LINES} JOIN (SELECT line, count(*) AS c FROM {LINES} GROUP BY 1) USING (line)")
def line_dedup(spark, d):
    lines = search.lines(table(spark, d, "documents"), "doc_id", "text").groupBy("line").agg(F.count(F.lit(1)).alias("c"))
    return lines.agg(F.sum("c").alias("n_lines"), F.count(F.lit(1)).alias("n_unique"), (F.sum("c") - F.count(F.lit(1))).alias("n_repeats"), F.max("c").alias("most"))


@query("SELECT min(event_id) AS run_start, event_type AS value, count(*) AS run_length FROM (SELECT event_id, event_type, sum(fresh) OVER (ORDER BY event_id) AS run FROM (SELECT event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY run, event_type")
def rle_runs(spark, d):
    return ordered.runs(table(spark, d, "events"), "event_id", "event_type")


STATUS = "CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 201 WHEN 'click' THEN 302 ELSE 200 END"


@query(f"SELECT event_id, {STATUS} - lag({STATUS}, 1, 200) OVER (ORDER BY event_id) AS delta FROM events")
def status_delta(spark, d):
    rows = table(spark, d, "events").select("event_id", F.expr(STATUS).alias("status"))
    rows = ordered.with_previous(rows, "event_id", F.col("status"), "last", default=200)
    return rows.select("event_id", (F.col("status") - F.col("last")).alias("delta"))


# --- line formats -------------------------------------------------------------


def _access_lines(spark, d):
    events = table(spark, d, "events")
    line = F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string"), F.lit(' - - [01/Jan/2024:00:00:00 +0000] "GET /'), F.col("event_type"), F.lit(' HTTP/1.1" '), F.expr(STATUS).cast("string"), F.lit(" "), F.when(F.col("event_id") % 10 == 0, "-").otherwise(F.col("event_id").cast("string")), F.lit(' "-" "agent"'))
    return events.select("event_id", F.when(F.col("event_id") % 97 == 0, "broken line").otherwise(line).alias("line"))


@query(f"SELECT status, count(*) AS n, count(DISTINCT ip) AS n_ips, sum(size) AS bytes FROM (SELECT CASE WHEN event_id % 97 <> 0 THEN {STATUS} END AS status, CASE WHEN event_id % 97 <> 0 THEN '10.0.0.' || (user_id % 256) END AS ip, CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 10 = 0 THEN -1 ELSE event_id END AS size FROM events) GROUP BY status")
def access_log_parse(spark, d):
    rows = formats.parse(_access_lines(spark, d), "line", "nginx")
    return rows.groupBy(F.col("status").cast("int").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ip").alias("n_ips"), F.sum("size").alias("bytes"))


@query("SELECT count(*) FILTER (event_id % 97 <> 0) AS parsed, count(*) FILTER (event_id % 97 = 0) AS raw FROM events")
def raw_bitmap(spark, d):
    rows = formats.parse(_access_lines(spark, d), "line", "apache")
    return rows.agg(F.count(F.when(~F.col("raw"), 1)).alias("parsed"), F.count(F.when(F.col("raw"), 1)).alias("raw"))


URL = r"^([a-z]+)://([^/?#]+)([^?#]*)(?:\?([^#]*))?"


@query(f"SELECT page_id, regexp_extract(url, '{URL}', 2) AS host, regexp_extract(url, '{URL}', 3) AS path, regexp_extract(url, '{URL}', 4) AS query FROM pages")
def url_fields(spark, d):
    part = lambda k: F.regexp_extract("url", URL, k)
    return table(spark, d, "pages").select("page_id", part(2).alias("host"), part(3).alias("path"), part(4).alias("query"))


@query("SELECT schema_id, action, count(*) AS n, sum(bytes) AS bytes FROM (SELECT CASE WHEN event_id % 50 = 0 THEN 3 ELSE 14 END AS schema_id, CASE WHEN event_id % 50 <> 0 THEN CASE WHEN event_type = 'error' THEN 'REJECT' ELSE 'ACCEPT' END END AS action, CASE WHEN event_id % 50 <> 0 THEN event_id END AS bytes FROM events) GROUP BY 1, 2")
def vpc_split(spark, d):
    e = table(spark, d, "events")
    line = F.format_string("2 123 eni-%d 10.0.0.1 10.0.0.2 80 443 6 10 %d 100 200 %s OK", F.col("user_id"), F.col("event_id"), F.when(F.col("event_type") == "error", "REJECT").otherwise("ACCEPT"))
    rows = formats.parse(e.select(F.when(F.col("event_id") % 50 == 0, "a b c").otherwise(line).alias("line")), "line", "vpcflow")
    return rows.groupBy("schema_id", "action").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bytes").cast("long")).alias("bytes"))


@query("SELECT stream, count(*) AS n, sum(length(event_type)) AS n_chars FROM (SELECT CASE WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END AS stream, event_type FROM events) GROUP BY 1")
def k8s_parse(spark, d):
    e = table(spark, d, "events").select(F.to_json(F.struct(F.col("event_type").alias("log"), F.when(F.col("event_type") == "error", "stderr").otherwise("stdout").alias("stream"), F.lit("2024-01-01T00:00:00Z").alias("time"))).alias("line"))
    return formats.parse(e, "line", "k8s").groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("log")).alias("n_chars"))


@query("SELECT 'host' || (user_id % 5) AS host, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS with_meta FROM events GROUP BY 1")
def vmware_parse(spark, d):
    meta = F.when(F.col("event_id") % 3 == 0, "[id=1] ").otherwise("")
    e = table(spark, d, "events").select(F.concat(F.lit("2024-01-01T00:00:00Z host"), (F.col("user_id") % 5).cast("string"), F.lit(" hostd: "), meta, F.col("event_type")).alias("line"))
    return formats.parse(e, "line", "vmware").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("meta") != "", 1)).alias("with_meta"))


@query("SELECT 'host' || (user_id % 5) AS host, event_type AS message, count(*) AS n, sum(event_id) AS pids FROM events GROUP BY 1, 2")
def syslog_parse(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("Jan  5 10:00:00 host"), (F.col("user_id") % 5).cast("string"), F.lit(" app["), F.col("event_id").cast("string"), F.lit("]: "), F.col("event_type")).alias("line"))
    return formats.parse(e, "line", "syslog").groupBy("host", "message").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("pid").cast("long")).alias("pids"))


@query("SELECT role AS type, 'user' || (conv_id % 10) AS actor, count(*) AS n FROM conversations GROUP BY 1, 2")
def github_lift(spark, d):
    name = F.concat(F.lit("user"), (F.col("conv_id") % 10).cast("string"))
    e = table(spark, d, "conversations").select(F.to_json(F.struct(F.col("role").alias("type"), F.struct(name.alias("login")).alias("actor"), F.struct(F.lit("a/b").alias("name")).alias("repo"))).alias("line"))
    return formats.parse(e, "line", "github").groupBy("type", "actor").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS \"eventName\", count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1")
def cloudtrail_lift(spark, d):
    record = F.struct(F.col("event_type").alias("eventName"), F.struct(F.col("user_id").cast("string").alias("userName")).alias("userIdentity"))
    documents = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 100).alias("g")).agg(F.to_json(F.struct(F.collect_list(record).alias("Records"))).alias("document"))
    return formats.cloudtrail(documents, "document").groupBy("eventName").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("userName").alias("n_users"))


@query("SELECT sum(len(regexp_extract_all(q, '[0-9]+'))) AS n_holes, count(DISTINCT regexp_replace(q, '[0-9]+', '?', 'g')) AS n_shapes FROM (SELECT 'SELECT a FROM t WHERE k = ' || o_orderkey || ' AND s = ' || o_custkey AS q FROM orders)")
def sql_template(spark, d):
    q = F.concat(F.lit("SELECT a FROM t WHERE k = "), F.col("o_orderkey").cast("string"), F.lit(" AND s = "), F.col("o_custkey").cast("string"))
    rows = templates.with_template(table(spark, d, "orders").select(q.alias("line")), "line", "sql")
    return rows.agg(F.sum(F.size("variables")).alias("n_holes"), F.countDistinct("template").alias("n_shapes"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS path, 0 AS packet, 0 AS record, s_suppkey + 167772160 AS src, s_nationkey + 3232235520 AS dst, 1 AS packets, s_suppkey + 40 AS bytes, 80 AS src_port, 443 AS dst_port, 6 AS protocol FROM supplier")
def netflow_transpose(spark, d):
    head = "0005" + "0001" + "00" * 20
    flow = F.concat(F.lpad(F.hex(F.col("s_suppkey") + 167772160), 8, "0"), F.lpad(F.hex(F.col("s_nationkey").cast("long") + 3232235520), 8, "0"), F.lit("00" * 8), F.lit("00000001"), F.lpad(F.hex(F.col("s_suppkey") + 40), 8, "0"), F.lit("00" * 8 + "0050" + "01bb" + "00" * 2 + "06" + "00" * 9))
    files = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.unhex(F.concat(F.lit(head), flow)).alias("content"))
    return binary.flows(files)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS path, 0 AS block_id, wide, n_name AS token FROM nation, (VALUES (true, 3), (false, 4)) AS kinds(wide, least) WHERE length(n_name) >= least")
def evtx_lift(spark, d):
    files = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("path"), F.concat(F.unhex(F.lit("FF00FF")), F.encode("n_name", "UTF-16LE"), F.unhex(F.lit("0000FFFF")), F.encode("n_name", "UTF-8"), F.unhex(F.lit("0000"))).alias("content"))
    return binary.block_tokens(files)


@query("SELECT path, 0 AS block_id, count(DISTINCT token) AS n_tokens FROM (SELECT CAST(doc_id AS VARCHAR) AS path, unnest(regexp_extract_all(text, '[0-9a-fA-F]{16,}|[A-Za-z0-9+/]{20,}={0,2}|[A-Za-z0-9_]{4,}')) AS token FROM documents) GROUP BY 1")
def universal_scan(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return binary.universal_blocks(files).groupBy("path", "block_id").agg(F.count(F.lit(1)).alias("n_tokens"))


# --- index --------------------------------------------------------------------

TOKENS = "(SELECT DISTINCT doc_id // 50 AS block_id, unnest(regexp_extract_all(lower(text), '[0-9A-Za-z_]{4,}')) AS token FROM documents)"


@query(f"SELECT block_id, count(*) AS n_tokens FROM {TOKENS} GROUP BY 1")
def token_index(spark, d):
    return index.token_index(table(spark, d, "documents"), "doc_id", "text", 50).groupBy("block_id").agg(F.count(F.lit(1)).alias("n_tokens"))


@query(f"SELECT (SELECT count(DISTINCT doc_id // 50) FROM documents) AS total_blocks, (SELECT count(DISTINCT block_id) FROM {TOKENS} WHERE contains(token, 'license')) AS candidate_blocks, (SELECT count(DISTINCT doc_id // 50) FROM documents) - (SELECT count(DISTINCT block_id) FROM {TOKENS} WHERE contains(token, 'license')) AS skipped_blocks, (SELECT CAST(sum((length(text) - length(replace(lower(text), 'license', ''))) / 7) AS BIGINT) FROM documents) AS hits")
def block_prune(spark, d):
    return index.block_report(table(spark, d, "documents"), "doc_id", "text", "license", 50)


PER_TOKEN = -math.log(0.01) / math.log(2) ** 2


@query(f"SELECT block_id, m, greatest(1, CAST(floor(m / n * {math.log(2)!r}) AS INT)) AS k FROM (SELECT block_id, n, CAST(greatest(64, ceil(n * {PER_TOKEN!r})) AS BIGINT) AS m FROM (SELECT block_id, greatest(count(*), 10) AS n FROM {TOKENS} GROUP BY 1))")
def bloom_blocks(spark, d):
    """Bits and probes of the filter of each block, by its number of tokens."""
    return index.bloom_index(table(spark, d, "documents"), "doc_id", "text", 50).select("block_id", "m", "k")


HOLDING = "SELECT count(DISTINCT doc_id // 50) AS holding, 0 AS missed FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[0-9A-Za-z_]{4,}'), 'license')"


def _missed(spark, d, fixed):
    """Blocks that hold the token, and how many of them the Bloom filters would have skipped."""
    docs = table(spark, d, "documents")
    blooms = index.bloom_index(docs, "doc_id", "text", 50, fixed=fixed)
    found = index.bloom_candidates(blooms, "license").withColumn("candidate", F.lit(1))
    holding = index.token_index(docs, "doc_id", "text", 50).where("token = 'license'").select("block_id")
    return holding.join(found, "block_id", "left").agg(F.count(F.lit(1)).alias("holding"), F.count(F.when(F.col("candidate").isNull(), 1)).cast("int").alias("missed"))


@query(HOLDING)
def bloom_prune(spark, d):
    return _missed(spark, d, None)


@query(HOLDING)
def bloom_fixed(spark, d):
    return _missed(spark, d, index.FIXED_BLOOM)


@query("SELECT CAST(doc_id AS VARCHAR) AS path, CAST((length(text) - length(replace(text, 'License', ''))) / 7 AS BIGINT) AS hits FROM documents")
def block_grep(spark, d):
    # The place of a row in front of its id: rows of one id stay apart.
    path = F.concat(F.monotonically_increasing_id().cast("string"), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    files = table(spark, d, "documents").select(path.alias("path"), F.encode("text", "UTF-8").alias("content"))
    sums = binary.block_grep(files, "License").groupBy("path").agg(F.sum("hits").alias("hits"))
    return sums.select(F.nullif(F.substring_index("path", "/", -1), F.lit("")).alias("path"), "hits")


# --- statistics -----------------------------------------------------------------


@query("SELECT source, n_bytes, round(log2(n_bytes) - s / n_bytes, 6) AS bits_per_byte FROM (SELECT source, sum(n) AS n_bytes, sum(n * log2(n)) AS s FROM (SELECT source, b, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents) GROUP BY 1, 2) GROUP BY 1)")
def byte_entropy(spark, d):
    return profile.byte_entropy(table(spark, d, "documents"), "text", ["source"])


@query("SELECT source, sum(n) AS n_lines, count(*) AS n_unique, round(count(*) / sum(n), 6) AS ratio FROM (SELECT source, line, count(*) AS n FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1, 2) GROUP BY 1")
def unique_line_ratio(spark, d):
    return profile.unique_line_ratio(table(spark, d, "documents"), "text", ["source"])


@query("SELECT round(avg(abs(d)), 6) AS mean_abs, round(median(abs(d)), 6) AS median_abs, CAST(max(abs(d)) AS DOUBLE) AS max_abs, round(avg(CASE WHEN d BETWEEN -128 AND 127 THEN 1 ELSE 0 END), 6) AS int8_share, round(avg(CASE WHEN d BETWEEN -32768 AND 32767 THEN 1 ELSE 0 END), 6) AS int16_share FROM (SELECT o_custkey - lag(o_custkey) OVER (ORDER BY o_orderkey) AS d FROM orders) WHERE d IS NOT NULL")
def delta_distribution(spark, d):
    return profile.delta_distribution(table(spark, d, "orders"), "o_orderkey", "o_custkey")


PART_BYTES = {"p_partkey": "CAST(p_partkey AS VARCHAR)", "p_name": "p_name", "p_brand": "p_brand", "p_type": "p_type", "p_size": "CAST(p_size AS VARCHAR)", "p_retailprice": "CAST(CAST(round(p_retailprice, 2) AS DECIMAL(18,2)) AS VARCHAR)"}


@query("WITH s AS (SELECT " + ", ".join(f"sum(strlen({e})) AS {c}" for c, e in PART_BYTES.items()) + " FROM part) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS BIGINT) AS bytes, round({c} / ({' + '.join(PART_BYTES)}), 6) AS share FROM s" for c in PART_BYTES))
def column_bytes(spark, d):
    return profile.column_bytes(table(spark, d, "part"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, CASE WHEN contains(text, chr(13) || chr(10)) THEN 'crlf' WHEN contains(text, chr(10)) THEN 'lf' ELSE 'none' END AS newline, CASE WHEN strlen(text) = length(text) THEN 'ascii' ELSE 'utf-8' END AS encoding, left(hex(encode(text)), 32) AS magic, sha256(text) AS sha256 FROM documents")
def file_stats(spark, d):
    return profile.file_facts(table(spark, d, "documents"), "doc_id", "text")


def _formats(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("origin"), F.col("text").alias("sample"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit("pages").alias("origin"), F.col("html").alias("sample"))
    events = table(spark, d, "events").select(F.col("event_id").alias("id"), F.lit("events").alias("origin"), F.col("props").alias("sample"))
    return docs.unionByName(pages).unionByName(events)


DETECT = r"""CASE WHEN length(s) = 0 THEN 'universal'
 WHEN (contains(s, '"Records"') OR contains(s, '"eventVersion"')) AND (contains(s, '"eventSource"') OR contains(s, '"userIdentity"')) THEN 'cloudtrail'
 WHEN contains(s, '"srcaddr"') AND contains(s, '"dstaddr"') THEN 'vpcflow'
 WHEN (contains(s, '"namespace"') AND contains(s, '"pod"')) OR (contains(s, '"log"') AND contains(s, '"stream"')) THEN 'k8s'
 WHEN contains(s, '"query"') OR contains(s, 'SELECT ') OR contains(s, 'INSERT INTO ') OR contains(s, 'UPDATE ') THEN 'sql'
 WHEN regexp_matches(f, '^\s*[{]') THEN 'json_columnar'
 WHEN regexp_matches(f, '^[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3} ') AND contains(s, 'nginx') THEN 'nginx'
 WHEN regexp_matches(f, '^[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3} ') THEN 'apache'
 WHEN regexp_matches(f, '^[A-Z][a-z]{2} +[0-9]') THEN 'syslog'
 WHEN contains(s, '"repo"') AND contains(s, '"actor"') THEN 'github' ELSE 'universal' END"""


@query(f"SELECT origin, engine, count(*) AS n FROM (SELECT origin, {DETECT} AS engine FROM (SELECT origin, left(x, 4096) AS s, string_split(ltrim(left(x, 4096), ' '), chr(10))[1] AS f FROM (SELECT 'documents' AS origin, text AS x FROM documents UNION ALL SELECT 'pages', html FROM pages UNION ALL SELECT 'events', props FROM events))) GROUP BY 1, 2")
def detect_format(spark, d):
    return _formats(spark, d).groupBy("origin", detect.detect_compat(F.col("sample")).alias("engine")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, CASE WHEN sum(n) < 10 THEN 'zstd' WHEN count(*) / sum(n) > 0.8 THEN 'zstd' ELSE 'columnar' END AS plan FROM (SELECT source, line, count(*) AS n FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1, 2) GROUP BY 1")
def route(spark, d):
    docs = table(spark, d, "documents")
    lines, bits = profile.unique_line_ratio(docs, "text", ["source"]), profile.byte_entropy(docs, "text", ["source"])
    return lines.join(bits, "source").select("source", detect.route(F.col("n_lines"), F.col("n_unique") / F.col("n_lines"), F.col("bits_per_byte"), F.lit(True)).alias("plan"))


@query("SELECT o_orderpriority AS dataset, max_by(engine, ratio) AS winner, max(ratio) AS best_ratio FROM (SELECT o_orderpriority, o_orderstatus AS engine, CAST(count(*) AS DOUBLE) + ascii(o_orderstatus) / 1000.0 AS ratio FROM orders GROUP BY 1, 2) GROUP BY 1")
def champion_rank(spark, d):
    ratios = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("engine")).agg((F.count(F.lit(1)).cast("double") + F.ascii("o_orderstatus") / 1000.0).alias("ratio"))
    return detect.champion(ratios, "dataset")


# --- metrics -----------------------------------------------------------------------

OPERATIONS = "(SELECT event_type AS engine, user_id AS tenant, event_id, CAST(event_id * 1000 + 1000 AS BIGINT) AS bytes_in, CAST(event_id * 37 + 100 AS BIGINT) AS bytes_out, value AS latency_ms, event_type = 'error' AS failed FROM events)"


def _operations(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("engine"), F.col("user_id").alias("tenant"), "event_id", (F.col("event_id") * 1000 + 1000).alias("bytes_in"), (F.col("event_id") * 37 + 100).alias("bytes_out"), F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("failed"))


KPIS = "operations, bytes_in, bytes_out, errors, round(bytes_in / bytes_out, 4) AS ratio, round((bytes_in - bytes_out) / 1073741824 * 0.023, 6) AS saved_usd, round(mean_latency, 4) AS mean_latency, round(mean_mb_s, 4) AS mean_mb_s, round(errors / operations * 100, 4) AS error_rate, round(least(100.0, bytes_in / bytes_out / 50 * 100), 4) AS efficiency, round((bytes_in - bytes_out) / 1073741824 * 0.023 * 365, 4) AS yearly_usd, round((bytes_in - bytes_out) / 1073741824 * 0.023 * 15, 6) AS roi_usd"
SUMS = "count(*) AS operations, CAST(sum(bytes_in) AS BIGINT) AS bytes_in, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, CAST(sum(CAST(failed AS INT)) AS BIGINT) AS errors, avg(latency_ms) AS mean_latency, avg(CASE WHEN latency_ms > 0 THEN bytes_in / 1048576 / (latency_ms / 1000) END) AS mean_mb_s"


@query(f"SELECT {KPIS} FROM (SELECT {SUMS} FROM {OPERATIONS})")
def kpi_total(spark, d):
    return metrics.key_figures(_operations(spark, d).agg(*metrics.totals()))


@query(f"SELECT engine, tenant, {KPIS} FROM (SELECT engine, tenant, {SUMS} FROM {OPERATIONS} GROUP BY GROUPING SETS ((engine), (tenant)))")
def kpi_by_tenant(spark, d):
    return metrics.key_figures(metrics.rollup(_operations(spark, d), "engine", "tenant"))


@query(f"SELECT event_id, avg(CAST(round(latency_ms * 100) AS BIGINT)) OVER (ORDER BY event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) / 100 AS rolling_ms FROM {OPERATIONS}")
def rolling_latency(spark, d):
    # Whole hundredths add up exactly, in any order.
    rows = _operations(spark, d).withColumn("latency_ms", F.round(F.col("latency_ms") * 100).cast("long"))
    return metrics.rolling_latency(rows, "event_id").withColumn("rolling_ms", F.col("rolling_ms") / 100)


@query("SELECT n_rows, raw_bytes, round(raw_bytes / n_rows * 1000000 * 30 / 1073741824, 6) AS gib_month, round(raw_bytes / n_rows * 1000000 * 30 / 1073741824 * 0.023, 6) AS usd_month FROM (SELECT count(*) AS n_rows, CAST(sum(strlen(l_returnflag) + strlen(l_linestatus) + 8 * 9) AS BIGINT) AS raw_bytes FROM lineitem)")
def storage_cost(spark, d):
    size = F.octet_length("l_returnflag") + F.octet_length("l_linestatus") + 8 * 9
    return metrics.storage_cost(table(spark, d, "lineitem"), size)


@query("SELECT least(c, s) AS low, greatest(c, s) AS high, count(*) AS n, round(sum(p), 2) AS gross, round(sum(CASE WHEN c < s THEN p ELSE -p END), 2) AS net FROM (SELECT c_nationkey AS c, s_nationkey AS s, l_extendedprice AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey) WHERE c <> s GROUP BY 1, 2")
def netting(spark, d):
    flows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return metrics.netting(flows, "c_nationkey", "s_nationkey", "l_extendedprice").withColumns({"gross": F.round("gross", 2), "net": F.round("net", 2)})


@query(f"SELECT engine, round(sum(bytes_in) / sum(bytes_out), 4) AS ratio, round(sum(bytes_in) / 1048576 / (sum(latency_ms) / 1000), 4) AS mb_s FROM {OPERATIONS} GROUP BY 1")
def compression_speed(spark, d):
    sums = _operations(spark, d).groupBy("engine").agg(F.sum("bytes_in").alias("i"), F.sum("bytes_out").alias("o"), F.sum("latency_ms").alias("ms"))
    return sums.select("engine", *metrics.compression(F.col("i"), F.col("o"), F.col("ms") / 1000))


@query("SELECT round(sum(8) / sum(8 + strlen(c_name) + strlen(c_mktsegment)), 6) AS share FROM customer")
def random_fraction(spark, d):
    sums = table(spark, d, "customer").agg((F.count(F.lit(1)) * 8).alias("r"), F.sum(8 + F.octet_length("c_name") + F.octet_length("c_mktsegment")).alias("t"))
    return sums.select(metrics.random_share(F.col("r"), F.col("t")).alias("share"))


# --- integrity -----------------------------------------------------------------------


@query("SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 11 = 0 THEN 'MISSING' WHEN doc_id % 7 = 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM documents")
def sha_manifest(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), "doc_id", F.sha2("text", 256).alias("digest"))
    manifest = docs.select("name", F.when(F.col("doc_id") % 7 == 0, F.reverse("digest")).otherwise(F.col("digest")).alias("digest"))
    return archive.check_manifest(docs.where("doc_id % 11 <> 0"), manifest).select("name", "status")


@query("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra")
def roundtrip_verify(spark, d):
    events = table(spark, d, "events").drop("ts")
    back = archive.restore_jsonl(events).select(F.from_json("value", events.schema).alias("x")).select("x.*")
    return archive.differences(events, back)


def _length(x: str) -> str:
    """A byte length, seven bits a byte, up to four bytes."""
    low = lambda k: f"(({x} >> {7 * k}) & 127)"
    return f"CASE WHEN {x} < 128 THEN unhex(printf('%02x', {x})) WHEN {x} < 16384 THEN unhex(printf('%02x%02x', {low(0)} | 128, {low(1)})) WHEN {x} < 2097152 THEN unhex(printf('%02x%02x%02x', {low(0)} | 128, {low(1)} | 128, {low(2)})) ELSE unhex(printf('%02x%02x%02x%02x', {low(0)} | 128, {low(1)} | 128, {low(2)} | 128, {low(3)})) END"


def _leaf(table: str, key: str, column: str, text: bool) -> str:
    cell = lambda c: f"'\"' || {c} || '\"'" if text else f"CAST({c} AS VARCHAR)"
    zone = f"""'{{"count":' || count(*) || ',"max":' || {cell(f"max({column})")} || ',"min":' || {cell(f"min({column})")} || ',"nulls":0,"type":"{"str" if text else "int"}"}}'"""
    parts = ", ".join(f"encode({x}) AS {n}" for n, x in (("a", f"'{column}'"), ("b", zone), ("c", f"'[' || string_agg({cell(column)}, ',' ORDER BY {key}) || ']'")))
    return f"SELECT '{column}' AS name, sha256(unhex('00') || {' || '.join(_length(f'octet_length({n})') + ' || ' + n for n in 'abc')}) AS leaf FROM (SELECT {parts} FROM {table})"


def _leaves(table: str, key: str, columns: dict[str, bool]) -> str:
    return " UNION ALL ".join(_leaf(table, key, c, t) for c, t in columns.items())


@query(_leaves("orders", "o_orderkey", {"o_orderkey": False, "o_custkey": False, "o_orderstatus": True, "o_orderpriority": True}))
def merkle_leaves(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return commit.column_leaves(orders, "row_id")


@query(
    "WITH RECURSIVE rows AS (SELECT n_nationkey AS seq, n_name AS payload FROM nation), chain(seq, payload, prev, hash) AS (SELECT seq, payload, repeat('00', 32), sha256(seq || '|' || payload || '|' || repeat('00', 32)) FROM rows WHERE seq = 0 UNION ALL SELECT r.seq, r.payload, c.hash, sha256(r.seq || '|' || r.payload || '|' || c.hash) FROM chain c JOIN rows r ON r.seq = c.seq + 1) SELECT 'audit' AS chain, CAST(seq AS BIGINT) AS seq, payload, prev, hash FROM chain"
)
def audit_chain(spark, d):
    rows = table(spark, d, "nation").withColumn("chain", F.lit("audit"))
    return security.chain_rows(rows, "chain", "n_nationkey", "n_name")


@query("SELECT event_type AS chain, true AS ok, count(*) AS n FROM events GROUP BY 1")
def audit_verify(spark, d):
    return security.verify_chain(security.chain_rows(table(spark, d, "events"), "event_type", "event_id", "props"))


# --- generated inputs ------------------------------------------------------------------


@query("SELECT level, region, count(*) AS n, count(DISTINCT service) AS n_services FROM (SELECT CASE WHEN i % 100 = 0 THEN 'ERROR' ELSE 'INFO' END AS level, CASE WHEN (i // 10) % 2 = 0 THEN 'eu' ELSE 'us' END AS region, i % 3 AS service FROM range(10000) t(i)) GROUP BY 1, 2")
def generated_logs(spark, d):
    return generate.agent_logs(spark, 10_000).groupBy("level", "region").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("service").alias("n_services"))


@query("SELECT status, currency, count(*) AS n, round(sum((100 + i * 7919 % 99900) / 100), 2) AS amount FROM (SELECT i, CASE WHEN i % 20 = 0 THEN 'FAILED' ELSE 'OK' END AS status, CASE WHEN i % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency FROM range(10000) t(i)) GROUP BY 1, 2")
def generated_payments(spark, d):
    return generate.payments(spark, 10_000).groupBy("status", "currency").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


@query("SELECT CAST(CASE i % 4 WHEN 2 THEN 304 WHEN 3 THEN 500 ELSE 200 END AS BIGINT) AS status, count(*) AS n, sum(100 + i * 7919 % 4901) AS bytes FROM range(10000) t(i) GROUP BY 1")
def generated_access_log(spark, d):
    rows = formats.parse(generate.access_log(spark, 10_000), "line", "nginx")
    return rows.groupBy(F.col("status").cast("long").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query("SELECT CASE WHEN i % 13 = 0 THEN 'REJECT' ELSE 'ACCEPT' END AS action, count(*) AS n, sum(i % 100 + 1) AS packets FROM range(10000) t(i) GROUP BY 1")
def generated_flow_log(spark, d):
    rows = formats.parse(generate.flow_log(spark, 10_000), "line", "vpcflow")
    return rows.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("packets").cast("long")).alias("packets"))


@query("SELECT i AS row_id FROM range(100, 150) t(i)")
def planted_token_grep(spark, d):
    """One column of sixteen is read; the planted id is outside the range of the others, so exactly the planted rows are found."""
    return search.where(generate.token_rows(spark, 10_000, planted=40_000).select("row_id", "t3"), "t3=40000").select("row_id")


@query("SELECT least(s, r) AS low, greatest(s, r) AS high, count(*) AS n FROM (SELECT 'agent-' || (i % 7) AS s, 'agent-' || (i * 3 % 7) AS r FROM range(5000) t(i)) WHERE s <> r GROUP BY 1, 2")
def generated_receipts(spark, d):
    stripped = generate.receipts(spark, 5_000).drop("signature", "prompt_hash")
    return metrics.netting(stripped, "sender", "receiver", "amount").select("low", "high", "n")
