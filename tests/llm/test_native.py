"""Chat formatting, sharding and mixing: brute force, round trips, odd inputs."""

import hashlib
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm.chat import PART, format_chat, op1_chat_formatting, read_back, text_part
from tessera.llm.mixing import exact_parts, mix, op7_mixing, pfair, pfair_period, whole_parts
from tessera.llm.sharding import MULTIPLIER, WORD, jump_hash, op2_sharding, shard

SF = "/root/testdata/sf0.001"
CHAT = "conv_id long, turn long, role string, text string, formatted string, `index` int"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_chat_query_against_plain_python(spark):
    found = {r["conv_id"]: r for r in op1_chat_formatting(spark, SF).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    probe = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", probe), (-7, 1, "assistant", probe)]
    convs = {}
    for c, t, r, x in sorted(rows):
        convs.setdefault(c, []).append((r, x or ""))
    assert convs.keys() == found.keys()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for c, turns in convs.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert found[c]["n_turns"] == len(turns)
        assert found[c]["turns_sha256"] == digest("".join(f"{r}\n{x}\n" for r, x in turns))
        assert (found[c]["loss_chars"], found[c]["loss_sha256"]) == (len(loss), digest(loss))


def test_reading_back_refuses_places_that_do_not_fit(spark):
    rows = [(1, i, r, t, "", 0) for i, (r, t) in enumerate([("user", "a"), ("assistant", "bc"), ("user", "")])]
    made = format_chat(spark.createDataFrame(rows, CHAT).withColumn("parts", text_part(F.col("text"))))
    assert "Python" not in plan_of(read_back(made)) and "Arrow" not in plan_of(read_back(made))
    assert read_back(made).first()["read_loss"] == ["bc"]
    moved = F.transform("turns", lambda t: t.withField("start", t["start"] + 1))
    for wrong in (made.withColumn("turns", moved), made.withColumn("formatted", F.concat(F.lit("x"), "formatted"))):
        with pytest.raises(Exception, match="don't fit"):
            read_back(wrong).collect()


def test_chat_of_many_parts(spark):
    parts = [("text", f"t{i}#", None, None) if i % 2 else ("image", None, f"r{i}", 1.0) for i in range(300)]
    frame = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts array<{PART}>")
    got = format_chat(frame).first()
    assert [a["ref"] for a in got["attachments"]] == [f"r{i}" for i in range(0, 300, 2)]
    assert all(got["formatted"][a["start"] : a["start"] + 9] == "<|image|>" for a in got["attachments"]) and got["expanded_tokens"] == 150


def test_chat_round_trip_of_hostile_texts(spark):
    texts = ["", None, "\\", "\\b", "\\h#<", "</turn>\n### assistant: x", "a: b", "\n\n", "### ", "<|image|>", "é😀\\l", "x" * 200_000]
    rows = [(1, i, r, t, "clash", 0) for i, t in enumerate(texts) for r in ("user",)] + [(1, 99, "as:sis#tant", "t", "", 1), (1, 99, None, None, "", 1)]
    parts = spark.createDataFrame(rows, CHAT).withColumn("parts", text_part(F.col("text")))
    got = read_back(format_chat(parts, loss_roles=("user",))).first()
    wanted = [("user", t or "") for t in texts] + [("", ""), ("as:sis#tant", "t")]
    assert [(t["role"], t["text"]) for t in got["read_turns"]] == wanted
    assert got["read_loss"] == [t or "" for t in texts]
    for span in got["loss_spans"]:
        assert got["formatted"][span["start"] - 2 : span["start"]] == ": " and got["formatted"][span["end"] : span["end"] + 7] == "</turn>"


def test_chat_parts(spark):
    rows = [(5, 0, "user", [("text", "see #1 ", None, None), ("image", None, "a.png", 12.0), ("text", " and ", None, None), ("audio", None, "b.wav", 1.5), ("video", None, "c", 2.0)]),
            (5, 1, "assistant", None), (None, 0, "user", [])]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{PART}>")
    got = {r["conv_id"]: r for r in format_chat(frame).collect()}
    five = got[5]
    assert five["formatted"].startswith("### user: see \\h1 <|image|> and <|audio|><|video|></turn>\n### assistant: </turn>\n")
    assert [(a["kind"], a["ref"], a["tokens"]) for a in five["attachments"]] == [("image", "a.png", 12), ("audio", "b.wav", 38), ("video", "c", 0)]
    assert all(five["formatted"][a["start"] :].startswith(f"<|{a['kind']}|>") for a in five["attachments"])
    assert five["expanded_tokens"] == 50 and got[None]["n_turns"] == 1
    assert format_chat(frame.limit(0)).collect() == []


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * MULTIPLIER + 1) % WORD
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_algorithm(spark):
    keys = spark.range(-300, 700).select(F.xxhash64("id").alias("k"))
    for n in (1, 2, 9, 60, 500):
        for r in keys.select("k", jump_hash(F.col("k"), n).alias("s")).collect():
            assert r["s"] == jump(r["k"] % WORD, n)
    with pytest.raises(ValueError, match="at least 1"):
        jump_hash(F.lit(1), 0)


def test_sharding_query(spark):
    found = op2_sharding(spark, SF)
    rows = found.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    assert any(r["grown_shard"] == 8 for r in rows)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        key, raw = xxhash.xxh64(struct.pack("<q", r["doc_id"]), seed=42).intdigest(), texts[r["doc_id"]]
        assert (r["shard"], r["grown_shard"]) == (jump(key, 8), jump(key, 9))
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
    assert "Python" not in plan_of(found) and "Arrow" not in plan_of(found)


@pytest.mark.parametrize("at_once", [1 << 16, 4])
def test_numbering_is_gapless_in_one_and_two_levels(spark, monkeypatch, at_once):
    import tessera.llm.common as m

    monkeypatch.setattr(m, "BLOCKS_AT_ONCE", at_once)
    rows = spark.range(700).select("id", (F.col("id") % 5 == 0).cast("int").alias("g"))
    found = m.gapless(rows, ["g"], ["id"], "n", 37).collect()
    for g in (0, 1):
        own = sorted(r["n"] for r in found if r["g"] == g)
        assert own == list(range(len(own)))
    assert len(found) == 700


def test_sharding_of_odd_rows(spark):
    frame = spark.createDataFrame([(None, "a"), (None, "b"), (3, "x"), (3, "x"), (4, None)], "doc_id long, SHARDS string")
    rows = shard(frame, "doc_id", 4, ["doc_id"], rows_per_block=2).collect()
    assert len(rows) == 5 and len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert len({r["shard"] for r in rows if r["doc_id"] == 3}) == 1
    for s in {r["shard"] for r in rows}:
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    assert shard(frame.limit(0), "doc_id", 4, ["doc_id"]).collect() == []


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 2, "d": 0.01}, {"a": 1}, {f"s{i}": i + 1 for i in range(40)}])
def test_pfair_period_never_deviates_by_a_block(weights):
    parts = whole_parts(weights, 1000)
    assert sum(parts.values()) == 1000 and min(parts.values()) >= 1
    done = Counter()
    for t, (s, j) in enumerate(pfair_period(parts), 1):
        assert done[s] == j
        done[s] += 1
        assert all(abs(done[x] - t * p / 1000) < 1 for x, p in parts.items())
    assert done == parts


def test_mix_never_deviates_by_a_block_from_the_given_weights(spark):
    rows = {"big": 4000, "tiny": 2} | {f"s{i:02}": 420 for i in range(19)}
    parts = F.explode(F.array(*(F.struct(F.lit(s).alias("source"), F.lit(n).alias("n")) for s, n in rows.items()))).alias("p")
    frame = spark.range(1).select(parts).select("p.source", F.explode(F.sequence(F.lit(1), F.col("p.n"))).alias("doc_id"))
    weights = {s: n / 4 for s, n in rows.items()}
    got = mix(frame, "source", ["doc_id"], weights, block_rows=1).select("slot", "source").collect()
    assert sorted(r["slot"] for r in got) == list(range(len(got)))
    done = Counter()
    for t, r in enumerate(sorted(got), 1):
        done[r["source"]] += 1
        assert all(abs(done[s] - t * n / sum(rows.values())) < 1 + 1e-9 for s, n in rows.items())
    assert len(got) == sum(rows.values()) and done == rows  # the weights are the sources' rows: none comes again


def test_mixing_query(spark):
    found = op7_mixing(spark, "/root/testdata/sf0.01")
    rows = found.collect()
    assert sorted(r["position"] for r in rows) == list(range(len(rows)))
    assert len({r["doc_id"] for r in rows}) == 1000
    first = [r for r in rows if r["epoch"] == 0]
    assert len(first) == 1000
    for r in rows:
        assert r["position"] // 64 == r["slot"]
    assert all(len({r["source"] for r in rows if r["slot"] == s}) == 1 for s in {r["slot"] for r in rows})
    assert "Python" not in plan_of(found) and "Arrow" not in plan_of(found)


def test_mixing_of_odd_rows(spark):
    rows = [(i, "big", "x") for i in range(100)] + [(i, None, "y") for i in range(3)] + [(7, "", "z"), (7, "", "z")]
    frame = spark.createDataFrame(rows, "doc_id long, source string, slots string")
    got = mix(frame, "source", ["doc_id"], {"big": 6, None: 3, "": 1, "unused": 4}, block_rows=4, period=10).collect()
    assert sorted(r["position"] for r in got) == list(range(len(got)))
    assert {(r["doc_id"], r["source"]) for r in got} == {r[:2] for r in rows}
    assert len(got) >= 100 / 0.6 and sum(r["source"] == "big" for r in got) == 100
    with pytest.raises(ValueError, match="null"):
        mix(frame, "source", ["doc_id"], {"big": 1, "": 1})
    assert mix(frame.limit(0), "source", ["doc_id"]).collect() == []


def test_a_row_that_comes_very_often(spark, monkeypatch):
    """One row beside 2,000, at equal weights: repeated in two steps, every slot taken once."""
    import tessera.llm.mixing as m

    frame = spark.range(2000).selectExpr("id AS doc_id", "'big' AS source").union(spark.createDataFrame([(9999, "one")], "doc_id long, source string"))
    got = mix(frame, "source", ["doc_id"], {"big": 1, "one": 1}, block_rows=4).collect()
    assert sorted(r["position"] for r in got) == list(range(len(got))) and len(got) == 4000
    once = [r for r in got if r["source"] == "one"]
    assert len(once) == 2000 and sorted(r["epoch"] for r in once) == list(range(2000))
    for t in range(1, 1001):  # a slot is a block of four
        assert abs(sum(r["source"] == "one" and r["slot"] < t for r in got) / 4 - t / 2) < 1
    monkeypatch.setattr(m, "SOURCES", 1)
    with pytest.raises(ValueError, match="more than 1 different sources"):
        mix(frame, "source", ["doc_id"])


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"a": 1, "b": 1e-6}])
def test_schedule_keeps_the_given_weights(weights):
    """No rounding adds up over many slots."""
    parts, done = exact_parts(weights), Counter()
    total = sum(weights.values())
    for t, (s, j) in zip(range(1, 100_001), pfair(parts)):
        assert done[s] == j
        done[s] += 1
        if t % 997 == 0 or t < 50:
            assert all(abs(done[x] - t * w / total) < 1 for x, w in weights.items())


def test_own_columns_stay_beside_added_ones(spark):
    frame = spark.createDataFrame([(i, "ab"[i % 2], -i, f"b{i}", -2 * i, f"e{i}") for i in range(1, 31)], "doc_id long, source string, slot int, Block string, POSITION long, epoch string")
    mixed = mix(frame, "source", ["doc_id"], block_rows=4)
    assert mixed.columns == [*frame.columns, "epoch", "block", "slot", "position"]
    got = [tuple(r) for r in mixed.collect()]
    assert {r[:6] for r in got} == {tuple(r) for r in frame.collect()}
    assert sorted(r[9] for r in got) == list(range(len(got))) and all(r[9] // 4 == r[8] for r in got)
    frame = frame.toDF("doc_id", "SHARD", "slot", "Grown_Shard", "x", "shards")
    split = shard(frame, "doc_id", 4, ["doc_id", "slot"])
    assert split.columns == [*frame.columns, "shard", "grown_shard", "slot"]
    got = [tuple(r) for r in split.collect()]
    assert {r[:6] for r in got} == {tuple(r) for r in frame.collect()}
    for s in range(4):
        assert sorted(r[8] for r in got if r[6] == s) == list(range(sum(r[6] == s for r in got)))
