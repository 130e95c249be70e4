"""Line dedup by a fixed-depth log-template tree, with DataFrame functions only.

A line is split at spaces, tabs and carriage returns; a token with a digit is a
variable field and becomes ``<*>``. The tree has fixed depth: token count, then
the leading ``LEAD`` tokens, then leaves with the templates of that path. In a
leaf, the remaining tokens of a template of at least ``MERGE_TOKENS`` tokens are
cut into ``PARTS`` equal parts; templates that agree in all parts but one, the
same one, generalise to a common template in which that part is a variable field.
Each template belongs to PARTS such groups, so every family of a leaf forms,
however many there are, and no order of the lines matters. A template is
recurring if it, or a group that it is in, is in at least two different texts.
Lines of recurring templates are dropped in all documents but the first (the
smallest id of those groups), so nothing leaves the corpus altogether.

Only hashes travel before the last join: 128 bits for a template and 32 for
each part. The parsed lines and their aggregate are written as tables, so
texts are parsed once. The count per template is aggregated before the shuffle, so a line
that a third of all documents share costs one row a task; the joins that follow
have one row per key on one side and can be split by the optimizer.

Cases: lines of fewer than ``MIN_TOKENS`` tokens and blank lines always stay.
Null texts stay null, empty ones empty; a document whose lines all go becomes
an empty text, never a lost row. Repeated rows (same id and text) get the same
lines. Copies of a text under other ids count as one text: whole copies are the
work of document dedup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._batches import packed, quoted
from .components import cut

MIN_TOKENS, LEAD, PARTS, MERGE_TOKENS = 3, 3, 4, 12
#: The hashes of the leading tokens and of the line name a template; two longs hold the hashes of its parts.
NAME = ["__lead", "__line"]
TEMPLATE = ["__n", *NAME, "__p01", "__p23"]


def masked(text: Column) -> Column:
    """Single spaces for white space inside lines, tokens with a digit as <*>."""
    flat = F.when(text.rlike("[\t\r]|  "), F.regexp_replace(text, "[ \t\r]+", " ")).otherwise(text)
    return F.when(flat.rlike("[0-9]"), F.regexp_replace(flat, "(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", "<*>")).otherwise(flat)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line that can be a template: id, hash of the text, line number and the hashes of TEMPLATE."""
    rows = docs.where(F.col(quoted(text_col)).isNotNull()).select(F.col(quoted(id_col)).alias("__id"), F.xxhash64(quoted(text_col)).alias("__text"), masked(F.col(quoted(text_col))).alias("__flat"))
    rows = rows.select("__id", "__text", F.posexplode(F.split("__flat", "\n", -1)).alias("__at", "__raw")).withColumn("__raw", F.btrim("__raw"))
    rows = rows.withColumn("__n", F.length("__raw") - F.length(F.replace(F.col("__raw"), F.lit(" "), F.lit(""))) + 1).where(F.col("__n") >= MIN_TOKENS)
    edge = lambda k: F.floor((F.col("__n") - LEAD) * k / PARTS).cast("int") + LEAD
    for k in range(PARTS + 1):
        rows = rows.withColumn(f"__to{k}", F.substring_index("__raw", " ", LEAD) if k == 0 else F.col("__raw") if k == PARTS else F.call_function("substring_index", F.col("__raw"), F.lit(" "), edge(k)))
    part = lambda k: F.hash(F.substr(f"__to{k + 1}", F.length(f"__to{k}") + 2)).cast("long")
    pair = lambda k: F.when(F.col("__n") >= MERGE_TOKENS, F.shiftleft(part(k), 32).bitwiseOR(part(k + 1).bitwiseAND(F.lit(0xFFFFFFFF)))).otherwise(F.lit(0))
    return rows.select("__id", "__text", "__at", "__n", F.xxhash64("__to0").alias("__lead"), F.xxhash64("__raw").alias("__line"), pair(0).alias("__p01"), pair(2).alias("__p23"))


def recurring(lines: DataFrame) -> DataFrame:
    """__lead, __line and __first (the id that keeps its lines) of recurring templates."""
    each = cut(lines.groupBy(*TEMPLATE).agg(F.min("__text").alias("__low"), F.max("__text").alias("__high"), F.min("__id").alias("__first")))
    short = each.where((F.col("__n") < MERGE_TOKENS) & (F.col("__low") != F.col("__high"))).select(*NAME, "__first")
    long = each.where(F.col("__n") >= MERGE_TOKENS)
    # Leaves that hold one text only cannot recur, whatever merges in them.
    # Aggregates are cut before they are joined, so that the optimizer can split the join at a hot leaf or template.
    live = cut(long.groupBy("__n", "__lead").agg(F.min("__low").alias("__low"), F.max("__high").alias("__high")).where("__low <> __high").select("__n", "__lead"))
    long = cut(long.join(live, ["__n", "__lead"], "left_semi"))
    upper, lower = F.lit(-(1 << 32)), F.lit(0xFFFFFFFF)
    blank = lambda k: (F.col("__p01").bitwiseAND(lower if k == 0 else upper) if k < 2 else F.col("__p01"), F.col("__p23").bitwiseAND(lower if k == 2 else upper) if k > 1 else F.col("__p23"))
    groups = F.array(*(F.struct(F.lit(k).alias("__k"), blank(k)[0].alias("__q01"), blank(k)[1].alias("__q23")) for k in range(PARTS)))
    member = long.withColumn("__group", F.explode(groups)).select("__n", *NAME, "__group.*", "__low", "__high", "__first")
    key = ["__n", "__lead", "__k", "__q01", "__q23"]
    found = cut(member.groupBy(*key).agg(F.min("__low").alias("__low"), F.max("__high").alias("__high"), F.min("__first").alias("__first")).where("__low <> __high").select(*key, "__first"))
    merged = member.select(*key, "__line").join(found, key).groupBy(*NAME).agg(F.min("__first").alias("__first"))
    return short.unionByName(merged)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__id, __text (hash) and __gone, the sorted numbers of the lines that go."""
    lines = cut(lines_of(docs, id_col, text_col))
    gone = lines.select("__id", "__text", "__at", *NAME).join(recurring(lines), NAME).where(F.col("__id") != F.col("__first"))
    return gone.groupBy("__id", "__text").agg(F.array_sort(F.collect_set("__at")).alias("__gone"))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with shortened texts; with ``counts`` also n_lines and n_dropped (replaced if there).

    A column n_chars, if there, is set to the new length.
    """
    gone = dropped_lines(docs, id_col, text_col)
    text = F.col(quoted(text_col))
    rows = packed(docs, id=F.col(quoted(id_col)), text=text, key=F.xxhash64(text))
    joined = rows.join(gone, (F.col("id") == F.col("__id")) & (F.col("key") == F.col("__text")), "left")
    joined = joined.withColumn("parts", F.when(F.col("__gone").isNotNull(), F.split("text", "\n", -1)))
    whole = F.col("__gone").isNull()
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("__gone")), lambda k: F.get(F.col("parts"), k)), "\n")
    joined = joined.withColumn("new", F.when(whole, F.col("text")).otherwise(kept))
    of = {c: F.col(f"row.{quoted(c)}") for c in docs.columns} | {text_col: F.col("new")}
    if "n_chars" in of and text_col != "n_chars":
        of["n_chars"] = F.when(whole, of["n_chars"]).otherwise(F.length("new")).cast(docs.schema["n_chars"].dataType)
    if counts:
        of["n_lines"] = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
        of["n_dropped"] = F.when(whole, 0).otherwise(F.size("__gone")).cast("long")
    return joined.select(*(c.alias(name) for name, c in of.items()))


#: The same rules for DuckDB over the table ``documents``; strings take the place of hashes.
ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, text, pos - 1 AS pos,
         regexp_replace(trim(regexp_replace(string_split(text, chr(10))[pos], '[ \\t\\r]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS tmpl
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents WHERE text IS NOT NULL)
), cut AS (
  SELECT doc_id, text, pos, tmpl, string_split(tmpl, ' ') AS tokens, len(string_split(tmpl, ' ')) AS n FROM lines
), keyed AS (
  SELECT doc_id, text, pos, tmpl, n, array_to_string(tokens[1:{LEAD}], ' ') AS lead,
         {", ".join(f"CASE WHEN n >= {MERGE_TOKENS} THEN array_to_string(tokens[{LEAD} + 1 + CAST(floor((n - {LEAD}) * {k} / {PARTS}.0) AS INT) : {LEAD} + CAST(floor((n - {LEAD}) * {k + 1} / {PARTS}.0) AS INT)], ' ') END AS p{k}" for k in range(PARTS))}
  FROM cut WHERE n >= {MIN_TOKENS}
), each AS (
  SELECT n, lead, tmpl, {", ".join(f"any_value(p{k}) AS p{k}" for k in range(PARTS))}, min(text) AS lo, max(text) AS hi, min(doc_id) AS first_id, count(*) AS c, min(pos) AS pos
  FROM keyed GROUP BY n, lead, tmpl
), member AS (
  SELECT tmpl, n, lead, lo, hi, first_id, k, {", ".join(f"CASE WHEN k <> {k} THEN p{k} END AS q{k}" for k in range(PARTS))}
  FROM each, range({PARTS}) AS parts(k) WHERE n >= {MERGE_TOKENS}
), found AS (
  SELECT n, lead, k, {", ".join(f"q{k}" for k in range(PARTS))}, min(first_id) AS first_id
  FROM member GROUP BY n, lead, k, {", ".join(f"q{k}" for k in range(PARTS))} HAVING min(lo) <> max(hi)
), clusters AS (
  SELECT tmpl, first_id FROM each WHERE n < {MERGE_TOKENS} AND lo <> hi
  UNION ALL
  SELECT m.tmpl, min(f.first_id) FROM member m JOIN found f ON m.n = f.n AND m.lead = f.lead AND m.k = f.k AND {" AND ".join(f"m.q{k} IS NOT DISTINCT FROM f.q{k}" for k in range(PARTS))} GROUP BY m.tmpl
), gone AS (
  SELECT DISTINCT k.doc_id, k.text, k.pos FROM keyed k JOIN clusters USING (tmpl) WHERE k.doc_id <> clusters.first_id
), lost AS (
  SELECT doc_id, text, list(pos) AS places FROM gone GROUP BY doc_id, text
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines, CAST(coalesce(len(places), 0) AS BIGINT) AS n_dropped,
       CASE WHEN places IS NULL THEN d.text ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(places, i - 1)), chr(10)) END AS text
FROM documents d LEFT JOIN lost ON d.doc_id = lost.doc_id AND d.text = lost.text
"""
