import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from strataq.functions import encode
from strataq.operators import commit, index, metrics, ordered, profile, search, security, templates
from strataq.plans import archive, detect
from strataq.sources import binary, formats

RECORDS = [{"ts": 1700000000 + i, "src": f"agent-{i % 3}", "amount": 1000 + 1.5 * i, "ok": i % 2 == 0, "note": None if i % 7 == 0 else f"n{i}"} for i in range(60)]


def numbered(spark, values, kind="long", start=0):
    return spark.createDataFrame([(start + i, v) for i, v in enumerate(values)], f"id long, v {kind}")


# --- order-dependent operators: edges between ranges, nulls, ties ---


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_ordered_operators_agree_with_a_loop(spark, width):
    r = random.Random(width)
    values = [r.choice([None, 1, 1, 2, 5]) for _ in range(40)]
    df = numbered(spark, values)
    got = {x["id"]: x["p"] for x in ordered.with_previous(df, "id", F.col("v"), "p", default=-7, width=width).collect()}
    assert got == {i: (-7 if i == 0 else values[i - 1]) for i in range(40)}
    total, want = 0, {}
    for i, v in enumerate(values):
        total += v or 0
        want[i] = total
    assert {x["id"]: x["s"] for x in ordered.with_running_sum(df, "id", F.coalesce("v", F.lit(0)), "s", width=width).collect()} == want
    runs = []
    for i, v in enumerate(values):
        if runs and runs[-1][1] == v:
            runs[-1][2] += 1
        else:
            runs.append([i, v, 1])
    assert sorted(map(tuple, ordered.runs(df, "id", "v").collect())) == sorted(map(tuple, runs))


def test_rolling_mean_over_range_edges(spark):
    df = numbered(spark, [float(i * i % 7) for i in range(50)], "double")
    got = {x["id"]: x["m"] for x in ordered.rolling_mean(df, "id", "v", 6, "m", width=8).collect()}
    values = [float(i * i % 7) for i in range(50)]
    assert all(abs(got[i] - sum(values[max(0, i - 5) : i + 1]) / len(values[max(0, i - 5) : i + 1])) < 1e-9 for i in range(50))


def test_ordered_operators_on_empty_tables(spark):
    df = numbered(spark, [])
    assert ordered.with_previous(df, "id", F.col("v"), "p").count() == ordered.runs(df, "id", "v").count() == 0


# --- encodings: the sound versions ---


def test_zigzag_and_varint(spark):
    values = [0, -1, 1, 2**62, -(2**63), 2**63 - 1, 63, 64, 127, 128]
    df = numbered(spark, values).select("v", encode.zigzag(F.col("v")).alias("z"))
    rows = df.select("v", "z", encode.unzigzag(F.col("z")).alias("back"), encode.varint_bytes(F.col("z")).alias("n")).collect()
    assert all(r["v"] == r["back"] for r in rows)
    size = lambda z: len(commit.length_prefix(z % 2**64))
    assert all(r["n"] == size(r["z"]) for r in rows)


def modes(spark, values, kind="string"):
    return profile.encoding_profile(numbered(spark, values, kind).select("v")).first()["mode"]


def test_null_outside_the_probed_places(spark):
    assert modes(spark, [1, 2, None, 4], "long") == "delta_int"
    assert modes(spark, ["a", None, "b"]) == "raw"


def test_whole_numbers_with_a_later_float_widen(spark):
    rows = formats.jsonl(spark.createDataFrame([('{"a": 1}',), ('{"a": 2.5}',)], "l string"), "l", "a double").collect()
    assert [r["a"] for r in rows] == [1.0, 2.5]


def test_many_distinct_values_keep_their_nulls(spark):
    values = [f"s{i}x" for i in range(300)] + [None]
    assert modes(spark, values) == "dict2"
    assert profile.cardinality(numbered(spark, values, "string").select("v")).first()["distinct"] == 300


def test_shuffled_suffixes_are_no_run(spark):
    assert modes(spark, [f"a{i}" for i in range(9)]) == "suffix"
    assert modes(spark, ["a0", "a5", "a5", "a1", "a2", "a3", "a4", "a6", "a8"]) != "suffix"


def test_iso_keeps_offset_of_each_row(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T02:00:00+02:00",), ("x",)], "t string")
    assert [r[0] for r in df.select(encode.iso_seconds(F.col("t"))).collect()] == [1704067200, 1704067200, None]


def test_ipv4(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("255.255.255.255",), ("256.1.1.1",), ("1.2.3",)], "t string").withColumn("n", encode.ipv4_to_long(F.col("t")))
    assert [tuple(r) for r in df.where("n is not null").select("n", encode.long_to_ipv4(F.col("n"))).collect()] == [(16909060, "1.2.3.4"), (4294967295, "255.255.255.255")]
    assert df.where("n is null").count() == 2


def test_mixed_case_hex_is_not_lifted(spark):
    row = spark.range(1).select(encode.liftable_hex(F.lit("ABCDEF0123456789")).alias("a"), encode.liftable_hex(F.lit("ABCdef0123456789")).alias("b")).first()
    assert row["a"] and not row["b"]


def test_delta_width(spark):
    for low, high, want in ((-128, 127, 1), (-129, 0, 2), (0, 32768, 4), (0, 2**31, 8)):
        assert spark.range(1).select(encode.delta_width(F.lit(low), F.lit(high))).first()[0] == want


# --- formats and templates ---


@pytest.mark.parametrize("form", sorted(templates.HOLES))
def test_templates_render_back(spark, form):
    r = random.Random(form)
    pieces = ["a", "12", '"q r"', " ", "[x]", "10.0.0.1", "'it\\'s'", "0xff", "NULL", "é", "\t", "-3.5", "", "\x00", "2024-01-01T00:00:00Z"]
    df = spark.createDataFrame([("".join(r.choice(pieces) for _ in range(r.randint(0, 12))),) for _ in range(200)], "line string")
    assert templates.with_template(df, "line", form).where(templates.rendered() != F.col("line")).count() == 0


def test_lines_that_do_not_match_stay(spark):
    df = spark.createDataFrame([('1.1.1.1 - - [t] "GET /" 200 -',), ("broken",), ("",), (None,)], "line string")
    rows = formats.parse(df, "line", "nginx").collect()
    assert [r["raw"] for r in rows] == [False, True, True, True]
    assert (rows[0]["status"], rows[0]["size"], rows[1]["line"]) == (200, -1, "broken")


def test_json_lines_lenient_and_strict(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("[1]",), ("{",), (" ",)], "l string")
    rows = formats.jsonl(df, "l", "a long").collect()
    assert [(r["a"], r["bad"]) for r in rows] == [(1, False), (None, True), (None, True)]
    with pytest.raises(Exception, match="bad JSON line"):
        formats.jsonl(df, "l", "a long", strict=True).collect()


def test_flow_packets_stop_at_truncation(spark):
    packet = struct.pack(">HH20x", 5, 2) + bytes(48) * 2
    assert len(binary.flow_records(packet * 3 + packet[:-1])[0]) == 6
    assert len(binary.flow_records(b"\0\7" + packet)[0]) == 0
    record = struct.pack(">II", 167772161, 167772162) + bytes(40)
    df = spark.createDataFrame([("f", bytearray(struct.pack(">HH20x", 5, 1) + record))], "path string, content binary")
    assert binary.flow_search(binary.flows(df), "10.0.0.2").count() == 1


# --- search and index ---


def test_query_language(spark):
    df = spark.createDataFrame([(1, "error here", 2.5), (2, "fine", None)], "id long, m string, x double")
    ids = lambda q: [r["id"] for r in search.where(df, q).collect()]
    assert ids("error") == [1] and ids('"error here"') == [1] and ids("id=2") == [2] and ids("x>2") == [1] and ids("regex:f.ne") == [2] and ids("m~^err") == [1] and ids("id=abc") == [] and ids("2.5") == [1]
    with pytest.raises(ValueError):
        search.where(df, "nothing=1")
    with pytest.raises(ValueError):
        search.search(df, "x", "other")


def test_typed_filter_reaches_the_scan(spark):
    plan = search.where(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), "o_totalprice > 250000.5")._jdf.queryExecution().toString()
    assert "GreaterThan(o_totalprice,250000.5)" in plan


def test_index_on_and_off_find_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokens = index.token_index(docs, "doc_id", "text", 10).cache()
    words = [r["token"] for r in tokens.select("token").distinct().orderBy(F.xxhash64("token")).limit(15).collect()]
    queries = words + [w[1:-1] for w in words[:5]] + [w.upper() for w in words[:3]] + ["zzzzqq", "a b", "é"]
    for q in queries:
        plain = {r[0] for r in docs.where(F.contains(F.lower("text"), F.lit(q.lower()))).select("doc_id").collect()}
        fast = {r[0] for r in index.pruned(docs, tokens, "doc_id", q, 10).where(F.contains(F.lower("text"), F.lit(q.lower()))).select("doc_id").collect()}
        assert plain == fast, q


def test_bloom_sizes():
    assert index.bloom_size(0) == index.bloom_size(10) and index.bloom_size(1000)[0] == 9586


# --- archive ---


def test_archive_round_trip_search_and_corruption(spark, tmp_path):
    df = spark.createDataFrame([(i, f"line {i} {'needle' if i == 7 else 'hay'}", None if i % 3 else float(i)) for i in range(200)], "id long, text string, x double")
    path = str(tmp_path / "a")
    manifest = archive.write(df, path, sort_by=["id"], index=("id", "text", 16))
    assert manifest["rows"] == 200
    assert archive.differences(df, archive.read(spark, path, verify=True)).first()[:] == (0, 0)
    assert [r["id"] for r in archive.search(spark, path, "needle").collect()] == [7]
    archive.restore(spark, path, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 200
    archive.write(df.where("id < 199"), str(tmp_path / "b"))
    os.system(f"rm -r {path}/data && cp -r {tmp_path}/b/data {path}/data")
    with pytest.raises(archive.CorruptArchive):
        archive.read(spark, path, verify=True)
    with pytest.raises(archive.CorruptArchive):
        archive.read(spark, str(tmp_path / "none"))
    for name in os.listdir(f"{tmp_path}/b/data"):
        if name.endswith(".parquet"):
            with open(f"{tmp_path}/b/data/{name}", "r+b") as f:
                f.truncate(20)
    with pytest.raises(archive.CorruptArchive):
        archive.read(spark, str(tmp_path / "b"), verify=True)


def test_raw_lines_when_the_parser_does_not_fit(spark, tmp_path):
    """A parser that asks for what the table lacks: raw lines and the reason. A job that fails is raised, not hidden."""
    df = spark.createDataFrame([("a",), ("b",)], "line string")
    made = archive.write_lines(df, "line", str(tmp_path / "r"), lambda d: d.select("other"))
    assert made["engine"] == "raw" and "other" in made["reason"] and archive.read(spark, str(tmp_path / "r"), verify=True).count() == 2
    with pytest.raises(Exception, match="no luck"):
        archive.write_lines(df, "line", str(tmp_path / "s"), lambda d: d.select(F.raise_error(F.lit("no luck"))))


def test_an_index_never_changes_the_answer(spark, tmp_path):
    rows = [(i, f"line {i} needle{'' if i % 9 else 's'}" if i % 5 == 0 else f"line {i}", "needle" if i % 31 == 0 else "x", float(i)) for i in range(3000)]
    rows += [(None, "a needle without a key", "y", 1.0), (None, "nothing", "needle here", 2.0), (5000, None, "needle", None)]
    df = spark.createDataFrame(rows, "id long, text string, note string, x double")
    archive.write(df, str(tmp_path / "plain"))
    for size in (16, 1000):  # many candidate blocks, which are joined, and few, which become ranges
        archive.write(df, str(tmp_path / f"i{size}"), sort_by=["id"], index=("id", "text", size))
        for query in ("needle", "Needle", "edle", "needles", "7", "line 7", "zzzz"):
            want = sorted(map(repr, archive.search(spark, str(tmp_path / "plain"), query).collect()))
            found, plan = archive.planned(spark, str(tmp_path / f"i{size}"), query)
            assert sorted(map(repr, found.collect())) == want, (size, query)
            assert plan.candidates is None or plan.candidates <= plan.blocks
    assert archive.planned(spark, str(tmp_path / "i16"), "zzzz")[1].candidates == 0


def test_zones_are_exact_and_prune_soundly(spark):
    df = spark.createDataFrame([(1, 0.126, "b", None), (9, 7.999, "a", None), (None, float("nan"), None, None)], "n long, x double, s string, e int")
    zones = {r["column"]: r.asDict() for r in profile.zone_map(df).collect()}
    assert (zones["n"]["low_long"], zones["n"]["high_long"], zones["n"]["nulls"]) == (1, 9, 1)
    assert zones["x"]["low_double"] == 0.126 and (zones["s"]["low_text"], zones["s"]["high_text"]) == ("a", "b")
    assert [profile.may_hold(zones["n"], v) for v in ("0", "1", "9", "10", "x")] == [False, True, True, False, False]
    assert profile.may_hold(zones["x"], "0.126") and profile.may_hold(zones["s"], "zzz") and not profile.may_hold(zones["e"], "1")


def test_order_ranges_are_even_however_values_lie(spark):
    r = random.Random(3)
    shapes = {"dense": range(4000), "far apart": [k << 20 for k in range(4000)], "clusters": [c * 10**12 + k for c in range(4) for k in range(1000)], "negative": range(-3000, 1000)}
    for name, values in shapes.items():
        rows = [(k, r.randint(0, 5)) for k in values]
        df = spark.createDataFrame(r.sample(rows, len(rows)), "id long, v long")
        got = {x["id"]: x["s"] for x in ordered.with_running_sum(df, "id", F.col("v"), "s").collect()}
        total, want = 0, {}
        for k, v in rows:
            total += v
            want[k] = total
        assert got == want, name
        counts = [x["count"] for x in ordered.ranges(df, "id", None).groupBy("__range").count().collect()]
        assert max(counts) <= 4 * 4000 / ordered.QUANTILES, (name, max(counts))


def test_entropy_equals_a_loop(spark):
    import math
    from collections import Counter

    texts = ["", None, "aab", "é€😀", "x" * 5000, "abc" * 7]
    df = spark.createDataFrame([(k % 2, t) for k, t in enumerate(texts)], "g int, t string")
    got = {r["g"]: (r["n_bytes"], r["bits_per_byte"]) for r in profile.byte_entropy(df, "t", ["g"]).collect()}
    for g in (0, 1):
        c = Counter(b"".join((t or "").encode() for k, t in enumerate(texts) if k % 2 == g))
        n = sum(c.values())
        assert got[g] == (n, pytest.approx(-sum(x / n * math.log2(x / n) for x in c.values()), abs=2e-6))
    assert profile.byte_entropy(df.limit(0), "t").count() == 0


def test_bloom_filters_miss_nothing_and_rarely_err(spark):
    tokens = spark.createDataFrame([(b, f"token{b}x{k}") for b in range(3) for k in (range(5), range(200), range(2000))[b]], "block_id long, token string")
    for fixed, most in ((None, 0.03), (index.FIXED_BLOOM, 0.05)):
        blooms = index.blooms_of(tokens, fixed=fixed).cache()
        assert {r["block_id"] for r in index.bloom_candidates(blooms, "token2x1999").collect()} >= {2}
        for b in range(3):
            assert b in {r["block_id"] for r in index.bloom_candidates(blooms, f"token{b}x3").collect()}
        probes = spark.range(400).select(F.concat(F.lit("other"), F.col("id").cast("string")).alias("t"))
        test = F.forall(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.array_contains(F.col("bits"), index.place(F.col("t"), j, F.col("m"))))
        assert probes.crossJoin(blooms).where(test).count() / 1200 <= most
        blooms.unpersist()


def test_bloom_filters_are_made_inside_the_row_of_a_block(spark):
    docs = spark.createDataFrame([(k, None if k == 7 else f"word{k % 4} Same{k} same{k} ab") for k in range(40)] + [(400, "a b")], "id long, t string")
    for fixed in (None, (64, 2)):
        blooms = index.bloom_index(docs, "id", "t", 10, fixed=fixed)
        got = {r["block_id"]: (r["m"], r["k"], r["bits"]) for r in blooms.collect()}
        words = {}
        for b, t in index.token_index(docs, "id", "t", 10).collect():
            words.setdefault(b, []).append(t)
        assert set(got) == set(words) == {0, 1, 2, 3}
        for b, (m, k, bits) in got.items():
            assert (m, k) == (fixed or index.bloom_size(len(words[b])))
            each = spark.createDataFrame([(w, j) for w in words[b] for j in range(k)], "w string, j long")
            assert bits == sorted({r[0] for r in each.select(index.place(F.col("w"), F.col("j"), F.lit(m).cast("long"))).collect()})
        plan = blooms._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("RepartitionBy") == 1


def test_leaves_of_a_table_equal_those_of_its_records(spark):
    rows = [{"i": k, "s": None if k % 7 == 0 else f"v{k}é\"", "x": k / 3, "b": k % 2 == 0, "l": [k, None], "none": None} for k in range(500)]
    df = spark.createDataFrame([(k, r["i"], r["s"], r["x"], r["b"], r["l"], None) for k, r in enumerate(rows)], "row_id long, i long, s string, x double, b boolean, l array<long>, none string")
    made, want = commit.commit(df.repartition(5), "row_id"), commit.commit_records(rows)
    assert {n: h for n, h in made.leaves if n != "l"} == {n: h for n, h in want.leaves if n != "l"}
    assert made.zones["x"] == want.zones["x"] and made.zones["none"] == {"type": "null", "count": 500, "nulls": 500}
    assert len(commit.commit(df.limit(0), "row_id").leaves) == 6


def test_leaves_sort_packed_pieces_and_not_the_rows_of_a_column(spark, monkeypatch):
    df = spark.createDataFrame([(k * 7919 % 3001, k % 3, None if k % 5 == 0 else f"é{k}") for k in range(3001)], "row_id long, a int, s string")
    rows = [{"a": r["a"], "s": r["s"]} for r in df.orderBy("row_id").collect()]
    monkeypatch.setattr(commit, "RANGE_ROWS", 400)
    leaves = commit.column_leaves(df.repartition(5), "row_id")
    assert {r["name"]: r["leaf"] for r in leaves.collect()} == dict(commit.commit_records(rows).leaves)
    # The last sort, of a whole column, has packed pieces and no cells.
    last = next(x for x in leaves._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Sort [" in x)
    assert "first" in last and "__order" not in last


def test_distinct_values_are_folded_in_parts(spark, monkeypatch):
    nan = float("nan")
    rows = [(k % 7, None if k % 3 else f"s{k}", (0.0, -0.0, nan, 1.5, None)[k % 5], "x", None) for k in range(900)]
    df = spark.createDataFrame(rows, "`a.b` int, s string, x double, c string, none long")
    monkeypatch.setattr(profile, "CELLS", 500)
    want = {"a.b": 7, "s": 300, "x": 3, "c": 1, "none": 0}
    assert profile.distinct_counts(df, df.columns) == want
    got = {r["column"]: (r["n"], r["distinct"], r["constant"]) for r in profile.cardinality(df).collect()}
    assert got == {"a.b": (900, 7, False), "s": (300, 300, False), "x": (720, 3, False), "c": (900, 1, True), "none": (0, 0, None)}
    # No row of all columns for each distinct aggregate.
    assert not any("Expand" in profile.__dict__[f](df.select("s", "c"))._jdf.queryExecution().toString() for f in ("cardinality", "encoding_profile"))


@pytest.mark.parametrize("form", sorted(profile.SMART))
def test_smart_modes_fold_distinct_values_in_parts(spark, form, monkeypatch):
    df = spark.createDataFrame([(f"a{k}", f"b{k % 255}", f"c{k % 256}", "x", None) for k in range(2000)], "many string, few string, edge string, one string, none string")
    monkeypatch.setattr(profile, "CELLS", 1000)
    modes = profile.smart_modes(df, form)
    assert dict(map(tuple, modes.collect())) == {"many": "raw", "few": "dictionary", "edge": "raw", "one": "constant", "none": "empty"}
    assert "Expand" not in modes._jdf.queryExecution().toString()


def test_profiles_by_format(spark):
    def mode(values, form):
        return profile.smart_modes(numbered(spark, values, "string").select("v"), form).first()["mode"]

    assert mode(["x"] * 5, "sql") == "constant" and mode(["1.2.3.4", "10.0.0.1", "9.9.9.9"], "vpcflow") == "ipv4"
    assert mode(["a", "b"] * 20, "github") == "dictionary" and mode([str(k) for k in range(40)], "syslog") == "delta"
    assert mode([f"{k:04d}" for k in range(40)], "sql") == "raw" and mode(["-0", "-1", "-2"], "sql") == "raw" and mode([None, None], "sql") == "empty"


def test_line_archives_of_hard_lines(spark, tmp_path):
    from strataq.plans import lines

    rows = [(k, t) for k, t in enumerate(["a 1 b 2", "a 3 b 4", "", None, "no holes", "raw \x00 9", 'say "x 1" 5', "a 1 b 2", "é 7"])]
    df = spark.createDataFrame(rows, "n long, line string")
    lines.write_templates(df, str(tmp_path / "t"), "n")
    lines.write_patterns(df, str(tmp_path / "p"), "n")
    for back in (lines.read_templates(spark, str(tmp_path / "t")), lines.read_patterns(spark, str(tmp_path / "p"))):
        assert sorted(map(tuple, back.collect())) == rows and lines.verify_lines(df, back, "n") == 9
    with pytest.raises(archive.CorruptArchive):
        lines.verify_lines(df, lines.read_patterns(spark, str(tmp_path / "p")).where("line_no <> 4"), "n")


def test_context_on_the_command_line(spark, tmp_path):
    from strataq import cli

    df = spark.createDataFrame([(k * 10, f"line {k}") for k in range(50)], "row_id long, line string")
    archive.write(df, str(tmp_path / "a"))
    got = [r["row_id"] for r in cli.hits(spark, str(tmp_path / "a"), '"line 20"', 2, None).collect()]
    assert got == [180, 190, 200, 210, 220]
    assert [r["row_id"] for r in cli.hits(spark, str(tmp_path / "a"), "line", 0, 3).collect()] == [0, 10, 20]


def test_command_line(spark, tmp_path, capsys):
    from strataq import cli

    (tmp_path / "in.json").write_text('{"a": 1, "m": "hit"}\n{"a": 2, "m": "miss"}\n')
    path = str(tmp_path / "arc")
    assert cli.main(["compress", str(tmp_path / "in.json"), path], spark) == 0
    assert cli.main(["search", path, "a=1"], spark) == 0 and '"m":"hit"' in capsys.readouterr().out
    assert cli.main(["verify", path], spark) == 0
    assert cli.main(["verify", str(tmp_path / "missing")], spark) == cli.CORRUPT
    assert cli.main(["decompress", str(tmp_path / "missing"), str(tmp_path / "o")], spark) == cli.CORRUPT and not (tmp_path / "o").exists()


# --- detection, metrics ---


@pytest.mark.parametrize("text, engine", [("", "universal"), ('{"a": 1}\n', "json_columnar"), ('1.2.3.4 - - [x] "GET / nginx"', "nginx"), ("1.2.3.4 - - [x]", "apache"), ("Jan  5 10:00:00 h p: m", "syslog"), ("SELECT 1", "sql"), ('{"log":"a","stream":"b"}', "k8s"), ("plain words", "universal")])
def test_detection(spark, text, engine):
    assert spark.range(1).select(detect.detect_compat(F.lit(text))).first()[0] == engine


def test_more_formats_are_detected(spark):
    row = spark.range(1).select(detect.detect(F.lit('{"repo": {}, "actor": {}}')), detect.detect(F.lit("2 123 eni-1 a b 1 2 3 4 5 6 7 A OK")), detect.detect(F.lit("2024-01-01T00:00:00Z h hostd: m"))).first()
    assert tuple(row) == ("github", "vpcflow", "vmware")


def test_netting_nets_pairs(spark):
    df = spark.createDataFrame([("a", "b", 5.0), ("b", "a", 2.0), ("a", "a", 9.0), ("c", "b", 1.0)], "p string, q string, v double")
    assert sorted(map(tuple, metrics.netting(df, "p", "q", "v").collect())) == [("a", "b", 2, 7.0, 3.0), ("b", "c", 1, 1.0, -1.0)]


def test_metrics_of_an_empty_log(spark):
    df = spark.createDataFrame([], "engine string, tenant string, bytes_in long, bytes_out long, latency_ms double, failed boolean")
    assert metrics.key_figures(df.agg(*metrics.totals())).first()["operations"] == 0


def test_metrics_stream(spark, tmp_path):
    from strataq.streaming import metrics_stream

    rows = spark.createDataFrame([(f"2024-01-01 00:0{i % 10}:00", "e", 10, 5, 1.0, False) for i in range(20)], "ts string, engine string, bytes_in long, bytes_out long, latency_ms double, failed boolean").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = metrics_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("metrics_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(operations) from metrics_out").first()[0] == 20


# --- commitment ---


def test_every_column_round_trips():
    c = commit.commit_records(RECORDS)
    for name in RECORDS[0]:
        values = [r[name] for r in RECORDS]
        proof = commit.InclusionProof.from_dict(c.proof(name).as_dict())
        assert commit.verify_inclusion(c.root, proof) and commit.verify_disclosure(c.root, proof, name, values, c.zones[name])
        assert not commit.verify_disclosure(c.root, proof, name, values[::-1], c.zones[name]) or values == values[::-1]


def test_key_order_does_not_matter_and_values_do():
    turned = [dict(reversed(r.items())) for r in RECORDS]
    assert commit.commit_records(RECORDS).root == commit.commit_records(turned).root
    assert commit.commit_records(RECORDS).root != commit.commit_records([RECORDS[0] | {"amount": 1.0}, *RECORDS[1:]]).root


def test_wrong_proof_and_name_fail():
    c = commit.commit_records(RECORDS)
    values = [r["amount"] for r in RECORDS]
    assert not commit.verify_disclosure(c.root, c.proof("ts"), "amount", values)
    assert not commit.verify_inclusion("00" * 32, c.proof("amount"))
    with pytest.raises(KeyError):
        c.proof("none")


def test_json_lines_give_the_same_root():
    import json

    assert commit.commit_jsonl("\n".join(map(json.dumps, RECORDS)) + "\n\n").root == commit.commit_records(RECORDS).root
    with pytest.raises(ValueError):
        commit.commit_jsonl('{"a": 1}\n{')


def test_single_column_and_empty():
    c = commit.commit_records([{"x": 1}, {"x": 2}])
    assert c.root == c.leaves[0][1] and c.proof("x").path == ()
    assert len(commit.commit_records([]).root) == 64


def test_zones_are_exact_and_lying_ones_rejected():
    c = commit.commit_records([{"amount": 5}, {"amount": 10}, {"amount": 1000}])
    assert c.zones["amount"] == {"type": "int", "count": 3, "nulls": 0, "min": 5, "max": 1000}
    assert not commit.verify_disclosure(c.root, c.proof("amount"), "amount", [5, 10, 1000], c.zones["amount"] | {"max": 1})
    mixed = commit.zone([1, "a", 2])
    assert "min" not in mixed and not commit.proves_above(mixed, 0)
    assert commit.proves_above(c.zones["amount"], 4) and not commit.proves_above(c.zones["amount"], 5)


def test_table_commitment_follows_row_order(spark):
    rows = [(i, f"v{i}", None if i == 2 else i * 2) for i in range(9)]
    a = spark.createDataFrame(rows, "id long, s string, n long")
    b = spark.createDataFrame(rows[::-1], "id long, s string, n long").repartition(3)
    want = commit.commit_columns({"s": [r[1] for r in rows], "n": [r[2] for r in rows]})
    assert commit.commit(a, "id").root == commit.commit(b, "id").root == want.root


# --- security ---


def test_envelope(spark):
    root = commit.commit_records(RECORDS).root
    sealed = security.seal(spark, b"data" * 50, "s3", "tenant", {"root": root})
    assert security.unseal(spark, sealed, "s3", "tenant") == (b"data" * 50, {"tenant": "tenant", "root": root})
    for secret, tenant, data in (("no", "tenant", sealed), ("s3", "other", sealed), ("s3", "tenant", sealed[:-1] + bytes([sealed[-1] ^ 1])), ("s3", "tenant", sealed[:60] + bytes([sealed[60] ^ 1]) + sealed[61:])):
        with pytest.raises(PermissionError):
            security.unseal(spark, data, secret, tenant)
    with pytest.raises(ValueError):
        security.unseal(spark, b"short", "s3", "tenant")


def test_no_default_key(monkeypatch):
    monkeypatch.delenv(security.SECRET_VARIABLE, raising=False)
    with pytest.raises(ValueError):
        security.derive(None, "t", b"0" * 16)


def test_audit_chain_detects_changes(spark):
    chain = security.AuditChain()
    chain.append("seal", {"tenant": "a"}, "2024-01-01")
    chain.append("anchor", {"tx": 1}, "2024-01-02")
    assert chain.verify() and chain.head() == chain.entries[1]["hash"]
    chain.entries[0]["meta"]["tenant"] = "b"
    assert not chain.verify() and security.AuditChain().head() == security.GENESIS
    rows = security.chain_rows(spark.createDataFrame([("x", i, f"p{i}") for i in range(5)], "c string, s long, p string"), "c", "s", "p")
    assert security.verify_chain(rows).first()["ok"]
    assert not security.verify_chain(rows.withColumn("payload", F.when(F.col("seq") == 2, "changed").otherwise(F.col("payload")))).first()["ok"]


# --- public functions, orchestration, generators ---


def test_public_functions(spark, tmp_path):
    from strataq import api

    path = str(tmp_path / "p")
    assert api.compress_records(spark, [{"a": 1, "m": "x"}, {"a": 2.5, "n": [1, {"k": None}]}], path)["rows"] == 2
    assert dict(api.decompress(spark, path).dtypes) == {"row_id": "bigint", "a": "double", "m": "string", "n": "string"}
    assert api.search(spark, path, "x").count() == 1
    (tmp_path / "in.json").write_text('{"a": 1}\n{bad\n\n{"a": 2}\n')
    assert api.compress(spark, str(tmp_path / "in.json"), str(tmp_path / "q"))["malformed"] == 1
    c = api.commit_records(RECORDS)
    assert api.verify_inclusion(c.root, api.inclusion_proof(c, "src"))
    assert api.secure_audit_log([("t", "seal", {}), ("u", "open", {})]).verify()
    assert api.column_type([2**70, 1]).typeName() == "string" and api.column_type([1, "a"]).typeName() == "string"


def test_encrypted_records(spark):
    from strataq import api

    envelope = api.compress_encrypted(spark, RECORDS, "s", "t")
    records, meta = api.decompress_encrypted(spark, envelope, "s", "t", return_meta=True)
    assert records == [{k: v for k, v in r.items() if v is not None} for r in RECORDS] and meta["root"] == commit.commit_records(RECORDS).root
    with pytest.raises(PermissionError):
        api.decompress_encrypted(spark, envelope, "s", "u")


def test_orchestration(spark, tmp_path):
    from strataq.plans.orchestrate import Orchestrator, checks, report

    lines = ['1.1.1.1 - - [t] "GET / nginx" 200 5', "broken", '2.2.2.2 - - [t] "GET /b" 404 -']
    (tmp_path / "log.txt").write_text("\n".join(lines) + "\n")
    o = Orchestrator(spark)
    made = o.compress(str(tmp_path / "log.txt"), str(tmp_path / "a"))
    assert made["format"] == "nginx" and made["rows"] == 3
    o.decompress(str(tmp_path / "a"), str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == lines
    assert o.chain.verify() and len(o.operations) == 2
    o.dump(str(tmp_path / "ops"))
    found = checks(spark, str(tmp_path / "a"), archive.read(spark, str(tmp_path / "a")))
    assert all(r["passed"] for r in found.collect()) and "identity" in report(found, str(tmp_path / "r.md"))


def test_generators(spark):
    from strataq.sources.generate import GENERATORS

    for make in GENERATORS.values():
        assert make(spark, 50).count() == 50
