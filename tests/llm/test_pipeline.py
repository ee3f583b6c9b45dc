"""The pipeline's stages, each against a plain version on its own input, and on odd tables."""

import random
import hashlib
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import plain_words
from test_text_operators import plain_resembling
from tokenizers import Tokenizer

from rastervec.llm import mixing, near_dedup, quality_rules
from rastervec.llm.common import stored, table, written_order

SF = "/root/testdata/sf0.001"


def plain_mix(rows):
    """Ids in training order from (doc_id, text, source): every occurrence at the time when its source's cumulative demand reaches it."""
    words = lambda t: len((t or "").encode().split())
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(words(t) for _, t, own in rows if own == s) for s in names}
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, left = {}, set(names)
    while True:  # reshare until no source is above three times its size
        level = (sum(size.values()) - sum(target.values())) / max(1, sum(weight[s] for s in left))
        above = {s for s in left if weight[s] * level > 3 * size[s]}
        target |= {s: 3 * size[s] for s in above}
        left -= above
        if not above:
            break
    target |= {s: weight[s] * level for s in left}
    placed = []
    for i, s in enumerate(names):
        w0, w1 = mixing.SCHEDULE[i % 3]
        demand = min(int(target[s] + 0.5), 3 * size[s])
        place = lambda d: int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16)
        start = 0
        for d, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: (place(r[0]), r[0])):
            n = words(t)
            for k in range(3):
                u = start + k * size[s]
                if n and u < demand and 2 * min(n, demand - u) >= n:
                    share = u / demand
                    placed.append((share * (w0 + w1) / (w0 + (w0 * w0 + (w1 * w1 - w0 * w0) * share) ** 0.5), place(d), d))
            start += n
    return [d for _, _, d in sorted(placed)]


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        seen.append(docs)
    assert all(d.columns == columns for d in seen[:-1])
    rows = [d.collect() for d in seen]
    ids = [sorted(r["doc_id"] for r in part) for part in rows]
    text = {r["doc_id"]: r["text"] for r in rows[0]}

    good = [r["doc_id"] for r in rows[0] for t in (quality_rules.Text(r["text"] or ""),) if not t.base_failed() and not any(rule(t) for rule in quality_rules.RULES.values())]
    assert ids[1] == sorted(good) and len(good) < len(rows[0])

    assert ids[2] == plain_resembling([(i, text[i]) for i in ids[1]]) and len(ids[2]) < len(ids[1])

    windows = set()
    for item in table(spark, SF, "benchmark").collect():
        w = plain_words(item["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in windows}
    hit = lambda t: any(tuple(w[i : i + n]) in windows for w in (plain_words(t),) for n in sizes for i in range(len(w) - n + 1))
    assert ids[3] == [i for i in ids[2] if not hit(text[i])]

    trained = [r["doc_id"] for r in seen[4].orderBy(*written_order()).select("doc_id").collect()]
    assert trained == plain_mix([(r["doc_id"], r["text"], r["source"]) for r in rows[3]])
    repeats = {i for i in trained if trained.count(i) > 1}
    assert repeats and not any(a == b for a, b in zip(trained, trained[1:]))  # occurrences have times of their own

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for i in trained:
        own = [*model.encode(text[i], add_special_tokens=False).ids, 2]
        want.append((i, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert [tuple(r) for r in sorted(rows[5], key=lambda r: r["start"])] == want


LONG = " ".join("".join("abcdefghij"[int(c)] for c in str(i)) for i in range(60_000))
GOOD = " ".join(f"plain{i}" for i in range(40))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, and columns with names that stages use themselves."""
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (None, GOOD, "en", None, 5), (3, GOOD, None, "a", 5), (3, GOOD, None, "a", 5), (4, LONG, "de", "b", 1), (5, "x " * 30, None, None, 1), (6, " ".join(reversed(GOOD.split())), "en", "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit("z") for c in ("_row", "_at", "_text", "node", "fp", "_kept", "size", "position", "a.b", "c0")})


def test_stages_on_odd_tables(spark, odd):
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = stored(stage(spark, stored(odd, "odd"), SF), name)
        empty = stage(spark, stored(odd.where("false"), "odd"), SF)
        assert empty.count() == 0 and seen[name].columns == empty.columns == (odd.columns if name != "tokens" else ["doc_id", "start", "n_tokens", "ids_crc32"])
    ids = {k: sorted((r["doc_id"] for r in v.collect()), key=str) for k, v in seen.items()}
    assert ids["quality"] == [3, 3, 4, 6, None]
    assert ids["near_duplicates"] == [1, 3, 4, 5, 6]  # null and empty texts are copies, and so are the rows with GOOD
    assert ids["decontaminated"] == sorted((r["doc_id"] for r in odd.collect()), key=str)
    assert set(ids["mixed"]) <= {3, 4, 5, 6, None} and 4 in ids["mixed"]
    assert ids["tokens"] == ids["decontaminated"]
    assert {r["n_tokens"] for r in seen["tokens"].where("doc_id in (1, 2)").collect()} == {1}


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and rows.count() > 0


def test_near_copies_with_a_run_in_all_sets(spark):
    """One passage in every text, groups of near copies, many ranges: the same documents stay as by comparing all pairs, with and without the bounds of fingerprints."""
    rng = random.Random(11)
    passage = " ".join(f"common{i}" for i in range(12))
    texts = []
    for _ in range(60):
        own = [f"w{rng.randint(0, 10**6)}" for _ in range(80)]
        texts.append(" ".join([passage, *own]))
        for _ in range(rng.choice([0, 0, 3])):
            near = list(own)
            near[rng.randrange(80)] = "changed"
            texts.append(" ".join([passage, *near]))
    texts += [passage] * 40 + [passage + f" end{i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sets = [set(near_dedup.resemblance_set(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    want = sorted(set(root))
    for exact in (False, True):
        assert sorted(r["doc_id"] for r in near_dedup.one_of_each(docs, exact=exact).collect()) == want


def test_neighbours_cross_the_borders_of_ranges(spark):
    rows = [(h, k, k % 7, k * 3) for h, many in ((5, 4000), (6, 1), (7, 2)) for k in range(many)]
    posts = spark.createDataFrame(rows, "hash long, node long, n int, fp long").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["node_a"], r["node_b"]) for r in near_dedup._neighbours(posts).where("n_a >= 0").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted((r for r in rows), key=lambda r: (r[0], r[2], r[1]))
    assert got == {(a[1], b[1]) for a, b in zip(order, order[1:]) if a[0] == b[0]}


def plain_bits(runs):
    """A set's fingerprint as a text of bits, a hash and a bit at a time."""
    low, longs = (1 << 64) - 1, []
    for k in range(near_dedup.WORDS):
        mixed = runs
        if k:
            mixed = [((h ^ (h >> 31)) * 0xD6E8FEB86659FD93 * 0x9E3779B97F4A7C15 ** (k - 1)) & low for h in runs]
            mixed = [h ^ (h >> 29) for h in mixed]
        longs += ["1" if 2 * sum(h >> bit & 1 for h in mixed) > len(runs) else "0" for bit in range(64)]
    return "".join(longs)


def test_segments_of_fingerprints_link_near_copies(spark):
    """Pairs that share a whole segment are those of a plain version, also where a segment crosses longs or a bucket is heavy; they are linked even if no run is there to share."""
    rng = random.Random(5)
    texts = []
    for many in [90, 110, 70, 320]:
        own = [f"w{rng.randint(0, 10**9)}" for _ in range(many)]
        for k in range(6):
            near = list(own)
            for _ in range(k * many // 250):
                near[rng.randrange(many)] = f"w{rng.randint(0, 10**9)}"
            texts.append(" ".join(near) + f" end{k}")
    docs = spark.createDataFrame([(t,) for t in texts], "_text string").repartition(3)
    entries = stored(near_dedup._with_sets(docs, prefix=True), "entries")
    sets_of = lambda nodes, late=None: near_dedup._with_sets(docs, prefix=late is not None, late=late).join(nodes, "node", "left_semi")
    sets = {r["node"]: {h & ((1 << 64) - 1) for h in r["set"]} for r in sets_of(entries.select("node")).collect()}
    bits = {node: plain_bits(sorted(runs)) for node, runs in sets.items()}
    near = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for size in (16, 20, 23, 32):
        shared = lambda a, b: any(bits[a][k : k + size] == bits[b][k : k + size] for k in range(0, 1024 - size + 1, size))  # noqa: E731, B023
        want = {p for p in near if shared(*p)}
        assert 20 < len(want)
        assert {tuple(r) for r in near_dedup.by_segments(entries, sets_of, size=size, heavy=64).collect()} == want
    full = {tuple(r) for r in near_dedup.by_segments(entries, sets_of, size=16, heavy=0).collect()}
    assert full and full <= set(near)
    alone = near_dedup.resemblances(entries.withColumn("set", F.expr("CAST(array() AS array<bigint>)")), sets_of)
    assert near_dedup.components(alone).where("node <> root").count() == len(texts) - 4


def test_batches_to_python_stay_small(spark, monkeypatch, tmp_path):
    """An executor holds what goes to Python several times outside its heap: a batch is of about a megabyte, a text goes once a pass, and near_dedup's don't come back."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randint(0, 10**9)}" for _ in range(1500)) for _ in range(400)]
    docs = stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), "large")
    total = sum(map(len, texts))

    def watched(module, real):
        def mapped(rows, function, schema, *rest):
            to = tmp_path / f"{module.__name__}-{len(list(tmp_path.iterdir()))}"
            to.touch()

            def counted(batches, at):
                for batch in batches:
                    with to.open("a") as file:
                        print(at, batch.nbytes, file=file)
                    yield batch

            return real(rows, lambda batches: counted(function(counted(batches, "in")), "out"), schema, *rest)

        monkeypatch.setattr(module, "mapped", mapped)

    for module in (quality_rules, near_dedup):
        watched(module, module.mapped)
    rules = {name: rule for name, rule in quality_rules.RULES.items()}
    assert quality_rules.good_documents(docs, rules=rules, sequence=list(rules)).where("length(text) > 0").count() <= 400
    assert near_dedup.one_of_each(docs).count() == 400
    seen = {}
    for file in sorted(tmp_path.iterdir()):
        part = [line.split() for line in file.read_text().splitlines()]
        seen[file.name] = [[int(n) for at, n in part if at == way] for way in ("in", "out")]
    assert all(n < 3 << 19 for into, _ in seen.values() for n in into)
    first = {name.partition("-")[0]: (into, out) for name, (into, out) in reversed(seen.items()) if into}
    quality, near = first["rastervec.llm.quality_rules"], first["rastervec.llm.near_dedup"]
    assert total <= sum(quality[0]) < 1.2 * total and total <= sum(near[0]) < 1.2 * total
    assert sum(near[1]) < total
