"""More of the query catalogue: archives written and read, searches over them, line archives, profiles by format, commitments, envelopes, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import api
from .catalog import TOKENS, _access_lines, _leaves, query, table
from .functions import encode
from .operators import commit, index, ordered, profile, search, security, templates
from .plans import archive, detect, lines, orchestrate
from .sources import binary, formats, generate
from .sources.folders import shared_folder
from .streaming import metrics_stream

# --- archives -------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_shipdate FROM lineitem")
def archive_roundtrip(spark, d):
    path = shared_folder(spark)
    archive.write(table(spark, d, "lineitem"), path, sort_by=["l_orderkey"])
    return archive.read(spark, path, verify=True).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def archive_max_mode(spark, d):
    path = shared_folder(spark)
    archive.write(table(spark, d, "customer"), path, mode="max")
    return archive.read(spark, path, verify=True).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT doc_id, lang, source FROM documents WHERE contains(text, 'License') OR contains(lang, 'License') OR contains(source, 'License')")
def archive_search(spark, d):
    """A word over all columns of an archive with a token index."""
    path = shared_folder(spark)
    archive.write(table(spark, d, "documents"), path, sort_by=["doc_id"], index=("doc_id", "text", 50))
    return archive.search(spark, path, "License").select("doc_id", "lang", "source")


@query("SELECT o_orderkey FROM orders WHERE contains(o_orderstatus, 'URG') OR contains(o_orderpriority, 'URG')")
def archive_search_part_of_a_word(spark, d):
    path = shared_folder(spark)
    archive.write(table(spark, d, "orders"), path, index=("o_orderkey", "o_orderpriority", 1000))
    return archive.search(spark, path, "URG").select("o_orderkey")


@query(f"SELECT (SELECT count(DISTINCT block_id) FROM {TOKENS}) AS blocks, (SELECT count(DISTINCT block_id) FROM {TOKENS} WHERE contains(token, 'license')) AS candidates, 'doc_id,n_chars' AS skipped")
def archive_search_plan(spark, d):
    """What the search for a word skips: whole-number columns cannot hold it, and neither can most blocks."""
    path = shared_folder(spark)
    archive.write(table(spark, d, "documents"), path, index=("doc_id", "text", 50))
    plan = archive.planned(spark, path, "license")[1]
    return spark.createDataFrame([(plan.blocks, plan.candidates, ",".join(sorted(plan.skipped)))], "blocks long, candidates long, skipped string")


@query("SELECT 'c_custkey' AS \"column\", (SELECT 21 BETWEEN min(c_custkey) AND max(c_custkey) FROM customer) AS tested UNION ALL SELECT 'c_nationkey', (SELECT 21 BETWEEN min(c_nationkey) AND max(c_nationkey) FROM customer) UNION ALL SELECT 'c_acctbal', (SELECT 21.0 BETWEEN min(c_acctbal) AND max(c_acctbal) FROM customer) UNION ALL SELECT 'c_name', true UNION ALL SELECT 'c_mktsegment', true")
def zone_prune(spark, d):
    """Which columns a search for 21 tests, by the zones of the archive."""
    path = shared_folder(spark)
    archive.write(table(spark, d, "customer"), path)
    plan = archive.planned(spark, path, "21")[1]
    return spark.createDataFrame([(c, c in plan.tested) for c in (*plan.tested, *plan.skipped)], "column string, tested boolean")


@query("SELECT c_custkey FROM customer WHERE c_custkey = 21 OR c_nationkey = 21 OR c_acctbal = 21.0 OR contains(c_name, '21') OR contains(c_mktsegment, '21')")
def zone_search(spark, d):
    path = shared_folder(spark)
    archive.write(table(spark, d, "customer"), path)
    return archive.search(spark, path, "21").select("c_custkey")


@query("SELECT * FROM (VALUES ('identity', true), ('determinism', true), ('format', true), ('changed value', true), ('missing row', true), ('added row', true)) AS t(test, passed)")
def archive_checks(spark, d):
    """A sound archive passes; copies with a changed, a missing or an added row are refused."""
    path, customer = shared_folder(spark), table(spark, d, "customer")
    archive.write(customer, path)
    return orchestrate.checks(spark, path, customer).select("test", "passed")


@query("SELECT count(*) AS n_rows, 'raw' AS engine, true AS reason FROM events")
def raw_fallback(spark, d):
    """A parser that does not fit the table: the lines are kept as they are and the manifest says why."""
    events = table(spark, d, "events").select(F.col("props").alias("line"))
    made = archive.write_lines(events, "line", shared_folder(spark), lambda df: df.select("no_such_column"))
    return spark.createDataFrame([(made["rows"], made["engine"], "no_such_column" in made["reason"])], "n_rows long, engine string, reason boolean")


@query("SELECT to_json(struct_pack(n_nationkey := n_nationkey, n_name := n_name, n_regionkey := n_regionkey)) AS value FROM nation")
def restored_jsonl(spark, d):
    path = shared_folder(spark)
    archive.write(table(spark, d, "nation"), f"{path}/a")
    archive.restore(spark, f"{path}/a", f"{path}/lines")
    return spark.read.text(f"{path}/lines")


@query("SELECT sha256(text) AS digest, CAST(doc_id AS VARCHAR) || '.txt' AS name FROM documents")
def manifest_lines(spark, d):
    path = shared_folder(spark)
    table(spark, d, "documents").select(F.concat(F.sha2("text", 256), F.lit("  some/folder/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("value")).write.text(f"{path}/manifest")
    return formats.read_manifest(spark, f"{path}/manifest").select("digest", "name")


RECORDS = [{"a": 1, "b": "x"}, {"a": 2, "c": 0.5}, {"b": None, "c": 7}, {}]


@query("SELECT * FROM (VALUES (0, 1, 'x', NULL), (1, 2, NULL, 0.5), (2, NULL, NULL, 7.0), (3, NULL, NULL, NULL)) AS t(row_id, a, b, c)")
def record_ingest(spark, d):
    """Records with differing keys: columns in first-seen order, whole numbers with floats widened."""
    path = shared_folder(spark)
    api.compress_records(spark, RECORDS, path)
    return api.decompress(spark, path)


@query("SELECT sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS total, count(*) AS n, true AS refused FROM events")
def strict_json(spark, d):
    """Strict reading of JSON lines; one bad line more is refused."""
    events = table(spark, d, "events").select("props")
    good = formats.jsonl(events, "props", "k long", strict=True).agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("n"))
    try:
        formats.jsonl(events.unionByName(spark.createDataFrame([("not json",)], "props string")), "props", "k long", strict=True).agg(F.sum("k")).collect()
        refused = False
    except Exception as e:
        refused = "bad JSON line" in str(e)
    return good.withColumn("refused", F.lit(refused))


# --- line archives --------------------------------------------------------

EVENT_LINE = "'user ' || user_id || ' did \"' || event_type || '\" as ' || event_id"


def _event_lines(spark, d):
    return table(spark, d, "events").select("event_id", F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(' did "'), F.col("event_type"), F.lit('" as '), F.col("event_id").cast("string")).alias("line"))


@query(f"SELECT event_id AS line_no, {EVENT_LINE} AS line FROM events")
def template_archive(spark, d):
    """Lines as templates, ids and variables, and back."""
    path, rows = shared_folder(spark), _event_lines(spark, d)
    lines.write_templates(rows, path, "event_id")
    restored = lines.read_templates(spark, path)
    lines.verify_lines(rows, restored, "event_id")
    return restored


@query(f"SELECT event_id AS line_no, {EVENT_LINE} AS line FROM events WHERE event_id BETWEEN 100 AND 120")
def template_archive_part(spark, d):
    """A few lines of a template archive: only their variables are read."""
    path = shared_folder(spark)
    lines.write_templates(_event_lines(spark, d), path, "event_id")
    return lines.read_templates(spark, path, F.col("line_no").between(100, 120))


@query("SELECT event_id AS line_no, event_type || ' ' || (user_id % 3) AS line FROM events")
def pattern_archive(spark, d):
    path = shared_folder(spark)
    rows = table(spark, d, "events").select("event_id", F.concat("event_type", F.lit(" "), (F.col("user_id") % 3).cast("string")).alias("line"))
    lines.write_patterns(rows, path, "event_id")
    restored = lines.read_patterns(spark, path)
    lines.verify_lines(rows, restored, "event_id")
    return restored


@query("SELECT event_id AS line_no, event_type || ' ' || (user_id % 3) AS line FROM events WHERE contains(event_type, 'err') OR contains(event_type || ' ' || (user_id % 3), 'err')")
def pattern_grep(spark, d):
    path = shared_folder(spark)
    lines.write_patterns(table(spark, d, "events").select("event_id", F.concat("event_type", F.lit(" "), (F.col("user_id") % 3).cast("string")).alias("line")), path, "event_id")
    return lines.grep_patterns(spark, path, "err")


def _shapes(form: str, line: str, rows: str) -> str:
    hole = templates.HOLES[form].replace("'", "''")
    return f"SELECT count(DISTINCT regexp_replace(line, '{hole}', chr(7), 'g')) AS n_templates, sum(len(regexp_extract_all(line, '{hole}'))) AS n_holes, 0 AS differing FROM (SELECT {line} AS line FROM {rows})"


def _templated(df, form):
    rows = templates.with_template(df, "line", form)
    return rows.agg(F.countDistinct("template").alias("n_templates"), F.sum(F.size("variables")).alias("n_holes"), F.count(F.when(templates.rendered() != F.col("line"), 1)).cast("int").alias("differing"))


ACCESS = "'10.0.0.' || (user_id % 256) || ' - - [01/Jan/2024:00:00:00 +0000] \"GET /' || event_type || ' HTTP/1.1\" 200 ' || event_id || ' \"-\" \"agent\"'"


def _plain_access(spark, d):
    return table(spark, d, "events").select(F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string"), F.lit(' - - [01/Jan/2024:00:00:00 +0000] "GET /'), F.col("event_type"), F.lit(' HTTP/1.1" 200 '), F.col("event_id").cast("string"), F.lit(' "-" "agent"')).alias("line"))


@query(_shapes("nginx", ACCESS, "events"))
def nginx_templates(spark, d):
    return _templated(_plain_access(spark, d), "nginx")


@query(_shapes("apache", ACCESS, "events"))
def apache_templates(spark, d):
    return _templated(_plain_access(spark, d), "apache")


@query(_shapes("k8s", "'{\"pod\": \"' || event_type || '\", \"n\": ' || event_id || '}'", "events"))
def k8s_templates(spark, d):
    return _templated(table(spark, d, "events").select(F.concat(F.lit('{"pod": "'), F.col("event_type"), F.lit('", "n": '), F.col("event_id").cast("string"), F.lit("}")).alias("line")), "k8s")


@query(_shapes("sql", "'SELECT a FROM t WHERE name = ''O\\''' || event_type || ''' AND k = -' || event_id || ' AND x IS NULL'", "events"))
def sql_templates(spark, d):
    """Literals with escaped quotes, signed numbers and NULL are holes."""
    return _templated(table(spark, d, "events").select(F.concat(F.lit("SELECT a FROM t WHERE name = 'O\\'"), F.col("event_type"), F.lit("' AND k = -"), F.col("event_id").cast("string"), F.lit(" AND x IS NULL")).alias("line")), "sql")


@query("SELECT event_type AS line, count(*) AS n, min(event_id) AS first_line, row_number() OVER (ORDER BY min(event_id)) - 1 AS line_id FROM events GROUP BY 1")
def line_dictionary(spark, d):
    """Distinct lines with their ids in first-seen order; the id stream is their join."""
    found = ordered.first_seen(table(spark, d, "events").select(F.col("event_type").alias("line"), "event_id"), ["line"], "event_id", "line_id")
    return found.select("line", "n", F.col("first_row").alias("first_line"), "line_id")


# --- greps of their own ---------------------------------------------------


@query("SELECT CAST(s_suppkey AS VARCHAR) AS path, s_suppkey + 167772160 AS src FROM supplier WHERE s_suppkey = 3 OR s_nationkey + 3232235520 = 167772163")
def ip_grep(spark, d):
    from .catalog import netflow_transpose

    return binary.flow_search(netflow_transpose(spark, d), "10.0.0.3").select("path", "src")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS path, CAST(2 * (length(n_name) - length(replace(n_name, 'IA', ''))) / 2 AS BIGINT) AS hits FROM nation")
def evtx_grep(spark, d):
    """Hits in both encodings of an event-log block."""
    files = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("path"), F.concat(F.unhex(F.lit("FF00FF")), F.encode("n_name", "UTF-16LE"), F.unhex(F.lit("0000FFFF")), F.encode("n_name", "UTF-8"), F.unhex(F.lit("0000"))).alias("content"))
    return binary.block_grep(files, "IA").groupBy("path").agg(F.sum("hits").alias("hits"))


@query("SELECT CAST(sum((length(event_type) - length(replace(event_type, 'r', ''))) / 1) AS BIGINT) AS hits FROM events")
def k8s_content_count(spark, d):
    """Occurrences in the log column only, not in the names around it."""
    e = table(spark, d, "events").select(F.to_json(F.struct(F.col("event_type").alias("log"), F.lit("stdout-r").alias("stream"), F.lit("r").alias("time"))).alias("line"))
    return formats.parse(e, "line", "k8s").agg(F.sum(search.occurrences(F.col("log"), "r")).alias("hits"))


@query("SELECT DISTINCT event_id // 100 AS block_id, lower(token) AS token FROM (SELECT event_id, unnest(['10.0.0.' || (user_id % 256), 'GET /' || event_type || ' HTTP/1.1', '-', 'agent']) AS token FROM events WHERE event_id % 97 <> 0)")
def rule_tokens(spark, d):
    """Address, request, referer and agent of access-log lines, per block of lines; lines that do not parse have none."""
    return index.rule_index(formats.parse(_access_lines(spark, d), "line", "nginx"), "nginx", "event_id", 100)


# --- profiles by format ---------------------------------------------------


def _smart(form: str, columns: dict[str, str], rows: str) -> str:
    share, number, addresses = profile.SMART[form]

    def mode(c: str) -> str:
        all_are = lambda p: f"count(*) FILTER (regexp_matches({c}, '{p}')) = count({c})"
        out = f"CASE WHEN count({c}) = 0 THEN 'empty' WHEN count({c}) > 1 AND min({c}) = max({c}) THEN 'constant'"
        out += f" WHEN {all_are(encode.IPV4)} THEN 'ipv4'" if addresses else ""
        out += f" WHEN count(DISTINCT {c}) < 256 AND count(DISTINCT {c}) < count({c}) * {share} THEN 'dictionary'"
        out += f" WHEN count({c}) > 1 AND {all_are(number)} AND {all_are(profile.SAFE_NUMBER)} AND max(length({c})) <= 18 THEN 'delta'" if number else ""
        return out + " ELSE 'raw' END"

    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {mode(c)} AS mode FROM (SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {rows})" for c in columns)


TEXTS = {"id": "CAST(event_id AS VARCHAR)", "kind": "event_type", "padded": "lpad(CAST(event_id AS VARCHAR), 7, '0')", "fixed": "'x'", "ip": "'10.1.' || (event_id // 256 % 256) || '.' || (event_id % 256)", "negative": "CAST(-event_id - 1 AS VARCHAR)"}


def _texts(spark, d):
    k = F.col("event_id")
    ip = F.concat(F.lit("10.1."), (F.floor(k / 256) % 256).cast("string"), F.lit("."), (k % 256).cast("string"))
    return table(spark, d, "events").select(k.cast("string").alias("id"), F.col("event_type").alias("kind"), F.lpad(k.cast("string"), 7, "0").alias("padded"), F.lit("x").alias("fixed"), ip.alias("ip"), (-k - 1).cast("string").alias("negative"))


@query(_smart("syslog", TEXTS, "events"))
def smart_syslog(spark, d):
    return profile.smart_modes(_texts(spark, d), "syslog")


@query(_smart("sql", TEXTS, "events"))
def smart_sql(spark, d):
    return profile.smart_modes(_texts(spark, d), "sql")


@query(_smart("vpcflow", TEXTS, "events"))
def smart_vpcflow(spark, d):
    return profile.smart_modes(_texts(spark, d), "vpcflow")


@query(_smart("github", TEXTS, "events"))
def smart_github(spark, d):
    return profile.smart_modes(_texts(spark, d), "github")


@query("SELECT event_id, id - lag(id, 1, 0) OVER (ORDER BY event_id) AS delta FROM (SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS id FROM events)")
def dict_delta(spark, d):
    """Ids in a sorted dictionary and their differences in row order."""
    events = table(spark, d, "events").select("event_id", "event_type")
    kinds = events.select("event_type").distinct()
    ids = kinds.select("event_type", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("long").alias("id"))  # a dictionary: under 65536 rows by the encoding's own rule
    rows = ordered.with_previous(events.join(ids, "event_type"), "event_id", F.col("id"), "last", default=0)
    return rows.select("event_id", (F.col("id") - F.col("last")).alias("delta"))


@query("SELECT page_id, CASE WHEN n_bytes < 102400 THEN 'zstd' WHEN bits > 7.5 THEN 'zstd' ELSE 'audition' END AS plan FROM (SELECT page_id, max(size) AS n_bytes, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS bits FROM (SELECT page_id, any_value(size) AS size, b, count(*) AS n FROM (SELECT page_id, strlen(html) AS size, unnest(regexp_extract_all(hex(encode(left(html, 4096))), '..')) AS b FROM pages) GROUP BY page_id, b) GROUP BY page_id)")
def size_route(spark, d):
    """By the size of a page and the entropy of its first characters."""
    pages = table(spark, d, "pages")
    bits = profile.byte_entropy(pages.select("page_id", F.substring("html", 1, detect.SAMPLE).alias("head")), "head", ["page_id"])
    return pages.join(bits, "page_id").select("page_id", detect.route_by_size(F.octet_length("html"), F.col("bits_per_byte")).alias("plan"))


# --- commitments and envelopes ----------------------------------------------

NATION = {"n_name": True, "n_nationkey": False, "n_regionkey": False}
_leaf_of = {c: f"(SELECT leaf FROM leaves WHERE name = '{c}')" for c in NATION}
_inner = f"sha256(unhex('01') || unhex({_leaf_of['n_name']}) || unhex({_leaf_of['n_nationkey']}))"


def _commitment(spark, d):
    return commit.commit(table(spark, d, "nation").withColumn("row_id", F.col("n_nationkey")), "row_id")


@query(f"WITH leaves AS ({_leaves('nation', 'n_nationkey', NATION)}) SELECT sha256(unhex('01') || unhex({_inner}) || unhex({_leaf_of['n_regionkey']})) AS root")
def merkle_root(spark, d):
    return spark.createDataFrame([(_commitment(spark, d).root,)], "root string")


@query("SELECT * FROM (VALUES ('n_name', 2, true, false, true, false), ('n_nationkey', 2, true, false, true, false), ('n_regionkey', 1, true, false, true, false)) AS t(name, steps, included, forged, disclosed, altered)")
def inclusion_proofs(spark, d):
    """A proof of each column, as text and back, holds; with a changed leaf, or other values, it does not."""
    made, nation = _commitment(spark, d), table(spark, d, "nation").orderBy("n_nationkey")
    out = []
    for c in NATION:
        proof = commit.InclusionProof.from_dict(made.proof(c).as_dict())
        forged = commit.InclusionProof(proof.name, proof.leaf[::-1], proof.path)
        values = [r[0] for r in nation.select(c).collect()]  # one column of 25 rows is what a disclosure hands over
        out.append((c, len(proof.path), commit.verify_inclusion(made.root, proof), commit.verify_inclusion(made.root, forged), commit.verify_disclosure(made.root, proof, c, values), commit.verify_disclosure(made.root, proof, c, values[1:])))
    return spark.createDataFrame(out, "name string, steps int, included boolean, forged boolean, disclosed boolean, altered boolean")


@query("SELECT * FROM (VALUES ('same', true), ('other tenant', false), ('other secret', false), ('changed byte', false), ('no secret', false)) AS t(attempt, opened)")
def envelope(spark, d):
    """Records sealed for a tenant open with the same secret and tenant only."""
    records = [r.asDict() for r in table(spark, d, "region").collect()]  # five records, one envelope
    sealed = api.compress_encrypted(spark, records, "secret", "tenant")

    def opened(data, secret, tenant):
        try:
            return api.decompress_encrypted(spark, data, secret, tenant) == records
        except (PermissionError, ValueError):
            return False

    changed = sealed[:-1] + bytes([sealed[-1] ^ 1])
    rows = [("same", opened(sealed, "secret", "tenant")), ("other tenant", opened(sealed, "secret", "else")), ("other secret", opened(sealed, "no", "tenant")), ("changed byte", opened(changed, "secret", "tenant")), ("no secret", opened(sealed, None, "tenant"))]
    return spark.createDataFrame(rows, "attempt string, opened boolean")


@query("SELECT count(DISTINCT r_name) AS n_keys, 64 AS n_bytes, true AS repeatable, true AS refused FROM region")
def tenant_keys(spark, d):
    """One key per tenant, the same each time; none without a secret."""
    names = [r[0] for r in table(spark, d, "region").select("r_name").collect()]
    keys = {security.derive("secret", n, b"0" * 16) for n in names}
    try:
        security.derive("", names[0], b"0" * 16)
        refused = False
    except ValueError:
        refused = True
    return spark.createDataFrame([(len(keys), len(min(keys)), keys == {security.derive("secret", n, b"0" * 16) for n in names}, refused)], "n_keys long, n_bytes int, repeatable boolean, refused boolean")


# --- streams and generated inputs -----------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 day, ts) AS start, event_type AS engine, count(*) AS operations, CAST(sum(event_id * 1000 + 1000) AS BIGINT) AS bytes_in FROM events GROUP BY 1, 2")
def streamed_totals(spark, d):
    """Totals per day and kind over the table read as a stream, to its end."""
    path, schema = shared_folder(spark), table(spark, d, "events").schema
    # A stream reads a folder: the file is copied into one.
    table(spark, d, "events").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{path}/in")
    operations = stream.select(F.col("event_type").alias("engine"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") * 1000 + 1000).alias("bytes_in"), F.col("event_id").alias("bytes_out"), F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("failed"))
    totals = metrics_stream(operations, window="1 day").select(F.col("window.start").alias("start"), "engine", "operations", "bytes_in")

    def store(batch, _):
        batch.write.mode("overwrite").parquet(f"{path}/out")

    totals.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(store).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT CASE WHEN i % 2 = 0 THEN 'stdout' ELSE 'stderr' END AS stream, count(*) AS n, count(DISTINCT i % 500) AS n_logs, count(DISTINCT i) AS n_pods FROM range(5000) t(i) GROUP BY 1")
def generated_containers(spark, d):
    return generate.containers(spark, 5_000).groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("log").alias("n_logs"), F.countDistinct("pod").alias("n_pods"))


@query("SELECT 'host' || (i % 4) AS host, count(*) AS n, sum(1000 + i * 7919 % 9000) AS pids FROM range(5000) t(i) GROUP BY 1")
def generated_system_log(spark, d):
    rows = formats.parse(generate.system_log(spark, 5_000), "line", "syslog")
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("pid").cast("long")).alias("pids"))


@query("SELECT CASE WHEN i % 2 = 0 THEN 'open' ELSE 'done' END AS status, count(*) AS n, sum(i % 200) AS total FROM range(5000) t(i) GROUP BY 1")
def generated_sql_log(spark, d):
    status = F.regexp_extract("query", "status = '([a-z]+)'", 1)
    return generate.sql_log(spark, 5_000).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("rows_returned").alias("total"))


