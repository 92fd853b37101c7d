"""Language, near-duplicates, personal data, packing and repeated passages: brute force and odd inputs."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.common import Scratch, components
from tessera.llm.language import DIMENSIONS, learn, letter_bits, op4_language_id, predict, unpacked
from tessera.llm.neardup import matches_for, near_duplicates, op6_near_duplicates, set_hash, shingle_sets, signature
from tessera.llm.packing import Encoder, column_generation, first_fit, op9_packing, pack, price, tokenizer_path, whole_patterns
from tessera.llm.personal import KINDS, base_spans, candidates, find_personal, luhn, masked, op8_personal_data, score_patterns
from tessera.llm.substrings import COVERS, cover, op10_substring_dedup, without_repeats
from tessera.llm.words import FIRST, SECOND, blocks

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = "doc_id long, text string, n_shingles string, `key` int, bucket int, id string"


def documents(spark, sf=SF):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def odd(spark, pairs):
    return spark.createDataFrame([(i, t, "clash", 1, 2, "x") for i, t in pairs], ODD)


def test_words_of_blocks():
    texts = ["a b\tc", "", None, " x ", "ab", "ab cd", "é ü\x0bz", "a  b\n", "  ", "Zz zZ", "a", "w" * 5000, "x " * 5000] * 3
    found = []
    for b in blocks(pa.array(texts)):
        h = b.hashes(FIRST, True)
        for i, j in itertools.pairwise(b.bounds):
            found.append([b.data[s:e].tobytes().decode() for s, e in zip(b.starts[i:j], b.ends[i:j], strict=True)])
            if found[-1] == ["Zz", "zZ"]:
                assert h[i] == h[i + 1]
    assert found == [WORD.findall(t or "") for t in texts]
    assert list(blocks(pa.array([], pa.string()))) == []


#: Two words of 1,024 bytes that every polynomial hash modulo 2^64 with an odd base takes for equal.
MORSE = "".join("ab"[i.bit_count() % 2] for i in range(1024))
ESROM = MORSE.translate(str.maketrans("ab", "ba"))


def test_word_hashes_differ():
    words = [MORSE, ESROM, *("a" * n for n in range(1, 40)), *("\0" * n for n in range(1, 20)), "abcdefgh", "abcdefghabcdefgh", "12345678abcdefgh", "abcdefgh12345678"]
    for family in (FIRST, SECOND):
        h = np.concatenate([b.hashes(family, False) for b in blocks(pa.array([" ".join(words)]))])
        assert len(h) == len(words) == len(set(h.tolist()))
        a, b = h[:2]
        morse = np.array([a if c == "a" else b for c in MORSE])
        esrom = np.array([a if c == "a" else b for c in ESROM])
        assert family.runs(morse, 1024)[0] != family.runs(esrom, 1024)[0] and family.whole(morse) != family.whole(esrom)
    assert len(FIRST.runs(h, 60)) == len(h) - 59


# --- language ---------------------------------------------------------------------------------------------------------


def test_language_query(spark):
    rows = op4_language_id(spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) / len(held) > 0.97


def test_language_of_odd_rows(spark):
    rows = [(1, "the cat and the hat", "en", 0.5), (2, "der Hund und die Katze", "de", None), (3, None, "de", 1.0), (4, "", None, 1.0),
            (5, "12 ,;\n", "en", 1.0), (None, "und der Hut der Frau", None, 1.0), (7, "漢字", None, 1.0), (8, "é" * 300_000, None, 0.0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    profiles = learn(frame, "text", "lang")
    assert list(profiles) == ["de", "en"]
    got = {r["doc_id"]: r for r in predict(frame, "text", profiles).collect()}
    assert got[None]["lang_pred"] == "de" and got[1]["lang_pred"] == "en" and got[1]["score"] > 0.9
    assert [got[i]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3 and got[3]["score"] == 0
    assert got[7]["lang_pred"] in profiles and got[8]["lang_pred"] in profiles
    assert predict(frame, "text", profiles).columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert learn(frame.limit(0), "text", "lang") == {}
    assert {r["lang_pred"] for r in predict(frame, "text", {}).collect()} == {"und"}
    assert predict(frame.limit(0), "text", profiles).collect() == []


def plain_bundle(text):
    """The sum of products of permuted letter vectors, n-gram by n-gram."""
    total = np.zeros(DIMENSIONS)
    gapped = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    points = [0, *(x for w in gapped for x in (*map(ord, w), 0))] if gapped else []
    for i in range(len(points) - 2):
        total += np.prod([np.roll(1 - 2 * unpacked(letter_bits(np.array([x])))[0].astype(int), 64 * (2 - k)) for k, x in enumerate(points[i : i + 3])], axis=0)
    return total


def test_language_against_plain_python(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([
        ("the cat and the hat", "en"), ("und der Hund", "de"), ("кот и пёс", "ru"), ("κότα", None), ("The Hat, 12 dogs!", None), ("漢字 かな", None), ("a", None), ("пёс Hund", None),
        ("the", "xa"), ("the", "xb"),
    ])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = learn(frame, "text", "lang")
    want = {}
    for _, t, lang in rows:
        if lang:
            want[lang] = want.get(lang, 0) + plain_bundle(t)
    assert all(np.allclose(profiles[k], v / np.linalg.norm(v)) for k, v in want.items()) and profiles.keys() == want.keys()
    for r in predict(frame, "text", profiles, carried=["doc_id"]).collect():
        own = plain_bundle(rows[r["doc_id"]][1])
        cosines = {k: own @ v / np.linalg.norm(own) / np.linalg.norm(v) for k, v in want.items()}
        assert r["lang_pred"] == min(cosines, key=lambda k: (-round(cosines[k], 9), k)) and abs(r["score"] - max(0, *cosines.values())) < 1e-9
    assert {r["lang_pred"] for r in predict(frame.where("doc_id >= 8"), "text", profiles).collect()} == {"xa"}  # a tie


def test_grams_of_pieces(monkeypatch):
    import tessera.llm.language as m

    rng = random.Random(6)
    texts = ["", " ", "a", "ab", "1", "a1b", "".join(rng.choice("abc é12,漢 ") for _ in range(400)), "  x" * 50]
    want = [m.grams(t) for t in texts]
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(m, "PIECE", size)
        for t, (codes, counts) in zip(texts, want, strict=True):
            got = m.grams(t)
            assert got[0].tolist() == codes.tolist() and got[1].tolist() == counts.tolist(), (size, t)
    assert sum(want[5][1]) == 3 and len(want[1][0]) == 0  # of the symbols gap, a, gap, b, gap


def test_more_languages_than_can_be_held(spark, monkeypatch):
    import tessera.llm.language as m

    monkeypatch.setattr(m, "LANGUAGES", 1)
    with pytest.raises(ValueError, match="more than 1 different"):
        learn(spark.createDataFrame([("a b", "x"), ("a b", "y")], "text string, lang string"), "text", "lang")


# --- near-duplicates --------------------------------------------------------------------------------------------------


def brute_components(texts, percent):
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_query(spark):
    got = {r["doc_id"]: r for r in op6_near_duplicates(spark, SF).collect()}
    want = brute_components(documents(spark).items(), 85)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_duplicates_of_large_groups(spark, monkeypatch):
    """Chains and a group whose members are only in part linked, over lists and groups of many blocks."""
    import tessera.llm.neardup as m

    monkeypatch.setattr(m, "LIST_ROWS", 8)
    monkeypatch.setattr(m, "GROUP_SHINGLES", 600)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"x{rng.randrange(9)}"
        texts.append((i, " ".join(w)))
    texts += [(100 + i, " ".join(f"c{j}" for j in range(i, i + 80))) for i in range(20)]
    want = brute_components(texts, 80)
    assert 3 < len({c for _, c in want.values()}) < 60
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(odd(spark, texts), "doc_id", "text").collect()}
    assert got == want


def test_near_duplicates_of_odd_rows(spark):
    pairs = [(5, "a b"), (3, "A  b"), (9, None), (8, ""), (8, " \n"), (None, "a b"), (None, None), (4, "a b c"), (7, "one two three four five six"),
             (7, "one two three four five six"), (None, "only null here"), (20, "z " * 100_000), (21, "z " * 90_000), (30, MORSE), (31, ESROM)]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(odd(spark, pairs), "doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted([
        (5, 1, 3, False), (3, 1, 3, True), (9, 0, 9, True), (8, 0, 8, True), (8, 0, 8, True), (None, 1, 3, False), (None, 0, None, True),
        (4, 1, 4, True), (7, 2, 7, True), (7, 2, 7, True), (None, 1, None, True), (20, 1, 20, True), (21, 1, 20, False), (30, 1, 30, True), (31, 1, 31, True),
    ], key=str)
    assert near_duplicates(odd(spark, []), "doc_id", "text").collect() == []


def test_few_links_are_lost():
    assert [matches_for(p) for p in (80, 85, 100, 1)] == [26, 30, 64, 1] and matches_for(85, 1e-8) == 36


def test_signature_matches_estimate_the_similarity():
    rng = np.random.default_rng(0)
    total = []
    for _ in range(200):
        common = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 10, dtype=np.uint64)])) for _ in range(2))
        total.append((signature(a) == signature(b)).mean())
    assert abs(np.mean(total) - 0.8) < 0.02
    s = next(shingle_sets(pa.array(["a b c d e f"])))
    assert set_hash(s) == set_hash(s[::-1]) != set_hash(s[:1])


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(200, i) for i in range(201, 300)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    found = components(Scratch(spark, "test"), spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in found} == {x: find(x) for x in linked} and len(found) == len(linked)
    assert components(Scratch(spark, "test"), spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def rows_joined(spark, work):
    """Rows that the joins of some work made, each join as often as it ran."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before, total = store.executionsCount(), 0
    work()
    bus.waitUntilEmpty()
    runs = store.executionsList(before, 1000)
    for i in range(runs.size()):
        run = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for metric in (node.metrics().apply(k) for k in range(node.metrics().size())) if "Join" in node.name() else ():
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    total += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return total


def test_components_of_a_group_that_met_in_many_places(spark):
    """Links that say again what others say don't go through the rounds, and the rounds cost the nodes of a group."""
    made = {}
    for size in (300, 600):
        links = [(100 + i, j) for i in range(size) for j in range(30)]
        frame = spark.createDataFrame(links, "a long, b long").repartition(8)
        found = []
        made[size] = rows_joined(spark, lambda frame=frame, found=found: found.extend(components(Scratch(spark, "test"), frame, "a", "b").collect()))
        assert {r["node"]: r["component"] for r in found} == {x: 0 for p in links for x in p}
        assert 0 < made[size] < 30 * size
    assert made[600] < 2.5 * made[300]


def test_components_of_more_links_than_a_task_takes_at_once(spark):
    chain = spark.range(1 << 11).selectExpr("id AS a", "id + 1 AS b")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(common, "FOREST_LINKS", 100)
        lots = [pa.record_batch({"u": pa.array(range(1, 951)), "v": pa.array(range(950))}), pa.record_batch({"u": [7, 8], "v": [3, 3]})]
        forest = [(u, v) for b in common._forest(iter(lots)) for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True)]
    assert len(forest) == 952 and all(u > v for u, v in forest)
    assert {v for _, v in forest} == {*range(0, 900, 100), 900, 3}
    assert {r["component"] for r in components(Scratch(spark, "test"), chain, "a", "b").collect()} == {0}


# --- personal data ----------------------------------------------------------------------------------------------------

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for k, (name, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": lambda m, d: True, "ip": lambda m, d: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda m, d: 16 <= len(d) <= 19 and luhn(d), "phone": lambda m, d: 8 <= len(d) <= 15,
            }[name]
            if fits(m, digits):
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(1)
    for alphabet in ("ab1 0259.@+-() %_é", "1 029.-+", "a@.b"):
        for _ in range(20_000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(50)))
            assert base_spans(text) == plain_spans(text), text
    assert base_spans("9" * 100_000 + "a" * 100_000 + "@" * 1000) == []
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_personal_query(spark):
    texts = documents(spark)
    for r in op8_personal_data(spark, SF).collect():
        spans = plain_spans(texts[r["doc_id"]] or "")
        listed = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == i for s in spans) for i in range(4)]
        assert set(filter(None, listed.split(","))) <= set(filter(None, r["spans"].split(",")))


def test_contexts_discover_unseen_identifiers(spark):
    pairs = [(i, f"Please call me at: +1 (578) 555-{1000 + i} now") for i in range(6)] + [(20 + i, f"Just mail me at bob{i}@x.com") for i in range(4)]
    pairs += [(9, "You can call me at: 555 123 4567 now"), (10, "It was 555 123 4567 units"), (11, None), (12, ""), (30, "he can mail me at jim (at) y.org or so"),
              (None, "do call me at 555 765 4321"), (None, "do call me at 555 765 4321"), (13, "we met at 12:30 on 3/4")]
    frame = odd(spark, pairs)
    found = find_personal(frame, "doc_id", "text")
    got = sorted(((r["doc_id"], [tuple(s) for s in r["spans"]], len(r["base"])) for r in found.collect()), key=str)
    more = {r[0]: r[1] for r in got if not r[2]}
    assert more == {9: [(3, 20, 32)], 10: [], 11: [], 12: [], 13: [], 30: [(0, 18, 32)], None: [(3, 14, 26)]} and len(got) == len(pairs)
    clean = {r["doc_id"]: r["text"] for r in masked(frame, "doc_id", "text", found, Scratch(spark, "test")).collect()}
    assert clean[9] == "You can call me at: [phone] now" and clean[0] == "Please call me at: [phone] now" and clean[10] == pairs[11][1] and clean[11] is None
    assert find_personal(odd(spark, []), "doc_id", "text").collect() == []


def brute_patterns(edges, rounds, support, confidence):
    """(context, kind) -> score of the trusted patterns; edges: context, value, kind of a base entity or -1, kinds it may be of."""
    held = {}
    for context, value, kind, may in edges:
        for of in range(len(KINDS)):
            if may >> of & 1:
                own = held.setdefault((context, of), {})
                own[value] = max(own.get(value, 0), int(kind == of))
    worth, trusted = {}, {}
    for _ in range(rounds):
        value_of = lambda of, v, base: 1.0 if base else worth.get((of, v), 0.0)
        scored = {k: [value_of(k[1], v, b) for v, b in own.items()] for k, own in held.items()}
        trusted = {k: sum(w) / len(w) for k, w in scored.items() if sum(x >= 0.5 for x in w) >= support and sum(w) / len(w) >= min(0.7, confidence)}
        miss = {}
        for (context, of), own in held.items():
            if (context, of) in trusted:
                for v, base in own.items():
                    if not base:
                        miss[of, v] = miss.get((of, v), 1.0) * (1 - trusted[context, of])
        worth = {k: 1 - m for k, m in miss.items()}
    return {k: s for k, s in trusted.items() if s >= confidence}


def test_discovered_values_seed_further_contexts(spark):
    """Two hops: the second context never has a base entity; a third has too many strangers to be trusted."""
    pairs = [(i, f"please call me +1 (578) 555-{1000 + i}") for i in range(40)] + [(100 + i, f"or call me 578 555 {2000 + i}") for i in range(8)]
    pairs += [(200 + i, f"the number home 578 555 {2000 + i}") for i in range(8)] + [(210, "my number home 578 555 3000"), (211, "units sold 578 555 3000")]
    pairs += [(300 + i, f"parts ordered 578 555 {2000 + i if i < 4 else 7000 + i}") for i in range(12)]
    got = {r["doc_id"]: len(r["spans"]) - len(r["base"]) for r in find_personal(odd(spark, pairs), "doc_id", "text").collect()}
    assert {i for i, n in got.items() if n} == {*range(100, 108), *range(200, 208), 210} and set(got.values()) == {0, 1}
    one_hop = {r["doc_id"]: len(r["spans"]) - len(r["base"]) for r in find_personal(odd(spark, pairs), "doc_id", "text", rounds=1).collect()}
    assert {i for i, n in one_hop.items() if n} == {*range(100, 108)}


@pytest.mark.parametrize("seed", range(3))
def test_patterns_against_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = []
    for _ in range(400):
        kind = rng.choice([-1, -1, 0, 3])
        value = rng.randrange(40) + 1000 * (kind + 1)
        edges.append((f"c{rng.randrange(12)}", f"v{value}", kind, 1 << kind if kind >= 0 else (8, 9, 1)[value % 3]))
    cues = spark.createDataFrame([(1, [(c, v, k, m, 0, 1) for c, v, k, m in edges])], "id int, cues array<struct<context string, value string, kind int, may int, start int, end int>>")
    got = {(r["context"], r["of"]): r["score"] for r in score_patterns(Scratch(spark, "test"), cues, 50, 2, 0.3).collect()}
    want = brute_patterns(edges, 50, 2, 0.3)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-2 for k in want) and want


def test_candidates_among_many_spans():
    text = " ".join(f"ip 10.0.{i // 256}.{i % 256} tel 555 {i:07d}" for i in range(20_000))
    base = base_spans(text)
    found = list(candidates(text, base))
    assert len(base) == 20_000 and len(found) == 20_000 and all(text[a:b].startswith("555 ") for _, a, b in found)
    overlapping = [(0, 5, 9), (1, 2, 20), (2, 25, 30)]
    digits = "0123 567890 345678901 345678"
    free = [(a, b) for _, a, b in candidates(digits, overlapping)]
    assert all(not any(x < b and a < y for _, x, y in overlapping) for a, b in free)


# --- packing ----------------------------------------------------------------------------------------------------------


def test_encoder_equals_the_tokenizer():
    e = Encoder(tokenizer_path())
    chars = [chr(i) for i in [*range(0x250), *range(0x2000, 0x2100, 3)]]
    rng = random.Random(0)
    texts = [t for c in chars for t in (c, f"A{c}b{c}{c}1", f"x {c}'s")] + ["<|endoftext|> a", "日本 text", "é", "it's 'RE don't", "\x1c a\x1d", ""]
    texts += ["".join(rng.choice(chars) if rng.random() < 0.3 else rng.choice("ab Éé'sdlvmre1½.,!-\n\t<|") for _ in range(rng.randrange(40))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoder_of_another_tokenizer():
    """One with other splitting gets whole texts."""
    import public_tokenizers

    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert Encoder(tokenizer_path()).by_pieces and not e.by_pieces
    for t in ("It's  one Text", "", "é\n\nx  y"):
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_of_long_texts(monkeypatch):
    import tessera.llm.packing as m

    rng = random.Random(4)
    e = Encoder(tokenizer_path())
    texts = ["".join(rng.choice("ab1's \n.é") for _ in range(500)), "x" * 300, " " * 300, "a b"]
    for size in (1, 5, 40):
        monkeypatch.setattr(m, "ENCODED_AT_ONCE", size)
        for t in texts:
            assert np.frombuffer(e.encode(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_forgets(monkeypatch):
    import tessera.llm.packing as m

    monkeypatch.setattr(m, "REMEMBERED", 10)
    e = Encoder(tokenizer_path())
    text = " ".join(f"w{i} {'long' * 30}" for i in range(50))
    assert np.frombuffer(e.encode(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids and len(e.known) <= 10


def check_packing(rows, ids, capacity):
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    covered = Counter()
    for r in rows:
        covered[r["doc_id"]] += r["length"]
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return covered, len(sequences)


def test_packing_query(spark):
    rows = op9_packing(spark, SF).collect()
    e = Encoder(tokenizer_path()).tokenizer
    ids = {i: [*e.encode(t or "", add_special_tokens=False).ids, 1] for i, t in documents(spark).items()}
    covered, many = check_packing(rows, ids, 2048)
    assert covered == {i: len(x) for i, x in ids.items()}
    assert sum(map(len, ids.values())) / (2048 * many) > 0.97


def test_packing_of_odd_rows(spark):
    pairs = [(1, None), (2, ""), (3, "word"), (3, "word"), (None, "a b c"), (4, "b " * 5000), (5, "b " * 2047), (6, "b " * 2048)]
    rows = pack(odd(spark, pairs), "doc_id", "text", tokenizer_path()).collect()
    e = Encoder(tokenizer_path()).tokenizer
    ids = {i: [*e.encode(t or "", add_special_tokens=False).ids, 1] for i, t in pairs}
    covered, _ = check_packing(rows, ids, 2048)
    assert covered == Counter({i: len(x) for i, x in ids.items()}) + Counter({3: len(ids[3])})
    assert pack(odd(spark, []), "doc_id", "text", tokenizer_path()).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_patterns_hold_the_demand(seed):
    rng = np.random.default_rng(seed)
    sizes = np.unique(rng.integers(1, 101, 30))
    demand = rng.integers(1, 200, len(sizes))
    program = column_generation(sizes, demand, 100)
    total = sum(x for _, x in program.patterns)
    assert np.allclose(sum(p * x for p, x in program.patterns), demand) and all(p @ sizes <= 100 for p, _ in program.patterns)
    assert program.pricings > 0 and sizes @ demand / 100 <= program.bound <= total + 1e-6 <= program.bound + 0.5 + 1e-5 * total + 1e-6
    whole = whole_patterns(sizes, demand, 100)
    assert (sum(p * n for p, n in whole) == demand).all() and all(p @ sizes <= 100 and n > 0 for p, n in whole)
    assert sum(n for _, n in whole) <= total * 1.02 + len(sizes)


def test_program_of_all_sizes_in_a_forked_process():
    """As many sizes as there can be: the driver has started a JVM, so BLAS with threads would hang."""
    rng = np.random.default_rng(1)
    sizes, demand = np.arange(1, 513), rng.integers(1, 60, 512)
    program = column_generation(sizes, demand, 512)
    total = sum(x for _, x in program.patterns)
    assert np.allclose(sum(p * x for p, x in program.patterns), demand) and program.bound <= total + 1e-6
    assert total <= sum(n for _, n in first_fit(sizes, demand, 512)) + 1e-6


def test_patterns_where_first_fit_wastes():
    """Sizes of which no first pattern is full: the duals' prices have to find the mixture."""
    sizes, demand = np.array([18, 34, 35, 45, 51]), np.array([500, 310, 640, 280, 410])
    program = column_generation(sizes, demand, 100)
    assert sum(x for _, x in program.patterns) <= program.bound + 0.5 + 1e-6
    every = [np.array(x) for x in itertools.product(*(range(100 // s + 1) for s in sizes)) if 0 < np.array(x) @ sizes <= 100]
    best, _ = price(sizes / 100, sizes, 100, 1)
    assert abs(best - max(x @ sizes for x in every) / 100) < 1e-9
    assert column_generation(sizes[:0], demand[:0], 100).patterns == [] and whole_patterns(sizes[:0], demand[:0], 100) == []


# --- repeated passages ------------------------------------------------------------------------------------------------


def brute_repeats(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_covers_are_difference_covers():
    for period, members in COVERS.items():
        assert {(a - b) % period for a in members for b in members} == set(range(period))
    assert cover(35) == (21, (0, 1, 4, 14, 16)) and cover(3)[0] == 1


def test_substring_query(spark):
    texts = documents(spark)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op10_substring_dedup(spark, SF).collect()}
    want = dict(zip(texts, brute_repeats(texts.values(), 35), strict=True))
    assert got == {i: (n, m, hashlib.sha256(k.encode()).hexdigest()) for i, (n, m, k) in want.items()}
    assert any(m for _, m, _ in got.values())


def test_substring_of_a_very_long_text(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(80_000)]
    words[60_000:60_100] = words[100:200]
    pairs = [(1, " ".join(words)), (2, " ".join(words[:40])), (3, " ".join(words[50_000:50_034]))]
    got = without_repeats(odd(spark, pairs), "doc_id", "text").collect()
    want = [(i, *x) for (i, _), x in zip(pairs, brute_repeats([t for _, t in pairs], 35), strict=True)]
    assert sorted(tuple(r) for r in got) == sorted(want) and want[0][2] == 240


@pytest.mark.parametrize("window", [2, 9, 35])
def test_substring_of_odd_rows(spark, monkeypatch, window):
    import tessera.llm.substrings as m

    monkeypatch.setattr(m, "TEXT_PER_GROUP", 3000)
    monkeypatch.setattr(m, "TEXT_PER_HASHES", 2000)
    rng = random.Random(window)
    shared = [f"s{i}" for i in range(window + 7)]
    pairs = [(1, None), (2, ""), (3, " \n"), (4, " ".join(shared[:window])), (5, " ".join(shared)), (5, " ".join(shared)), (None, "x " * 300), (None, "y")]
    pairs += [(6 + k, " ".join([*(f"t{i}" for i in range(window - 1)), word])) for k, word in enumerate((MORSE, ESROM))]
    for i in range(40):
        w = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(120))]
        at = rng.randrange(len(w) + 1)
        pairs.append((10 + i, "\t".join(w[:at] + shared[: rng.randrange(len(shared) + 1)] + w[at:])))
    got = without_repeats(odd(spark, pairs), "doc_id", "text", window).collect()
    want = [(i, *x) for (i, _), x in zip(pairs, brute_repeats([t for _, t in pairs], window), strict=True)]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert without_repeats(odd(spark, []), "doc_id", "text", window).collect() == []
