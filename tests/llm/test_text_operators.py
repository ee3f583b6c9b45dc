"""Operators on single texts against plain versions: quality rules, token counts, fingerprints, mixing, chats, token output."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rastervec.llm import chat_format, mixing, near_dedup, quality_rules, queries, token_count, token_output

LONG = " ".join(f"wort{i % 977}, Öl{i % 13}" for i in range(30_000))
TEXTS = [None, "", " ", "\n\t", "a", "Hello, World!  It's 5 o'clock.\n", "<|endoftext|> <|im_end|>x\\<|y\\|", "x\x1cy\x85z w v", "İstanbul ΣΑΣ é ﬁ", "日本語のテキスト。" * 40, "▁▁ a▁b", "aaaa" * 3000, "one two three " * 60, "#*$%& |<> " * 9, "same line here\n" * 30, "!" * 40, "WORD " * 40, "123 " * 30, LONG, "tail.", " ".join(a + b + "ly" for a in "abcdef" for b in "uvwxyz")]
ROWS = [(i, t, "sx" if i % 3 else None, "_t") for i, t in enumerate(TEXTS)] + [(4, "a", "sx", "_t"), (None, "no id", None, None), (None, None, None, None), (18, LONG, "b", "_t")]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with names that operators use themselves."""
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, source string, _text string")
    return rows.withColumns({c: F.lit(1) for c in ("_row", "_id", "fp", "size", "kept", "_hash", "_bucket", "position")}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def by_id(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_quality_measures_and_verdicts(docs, none):
    def plain(t):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
        lines = Counter(x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        kept = not failed and not any(rule(quality_rules.Text(t)) for rule in quality_rules.RULES.values())
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), sum(n - 1 for n in lines.values()), len(covered), failed, kept

    got = by_id(quality_rules.judge(docs))
    assert got == sorted(((r[0], *plain(r[1])) for r in ROWS), key=str)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)
    assert quality_rules.judge(none).count() == 0
    good = quality_rules.good_documents(docs)
    assert good.columns == docs.columns and good.count() == sum(r[-1] for r in got)


def test_cascade_order_changes_no_verdict(docs):
    names = list(quality_rules.RULES)
    assert by_id(quality_rules.judge(docs, sequence=names)) == by_id(quality_rules.judge(docs, sequence=names[::-1]))
    estimates = quality_rules.estimate(docs)
    assert sorted(estimates["rule"]) == sorted(names) and (estimates["cost"] >= 0).all()
    by_gain = quality_rules.order(estimates)
    assert list(estimates.set_index("rule").loc[by_gain, "gain"]) == sorted(estimates["gain"], reverse=True)


def test_the_sample_of_rules_is_bounded_when_texts_repeat(spark):
    same = spark.range(1000).select(F.lit("one text a thousand times " * 5).alias("text"))
    seen = []
    rules = {"count": lambda t: seen.append(1) or True}
    estimates = quality_rules.estimate(same, rules=rules, sample=100)
    assert estimates["selectivity"][0] == 1 and estimates["cost"][0] > 0
    assert 50 <= same.sample(0.1, seed=9).count() <= 150


def test_token_counts_equal_the_library(docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(token_count.count_tokens(docs, path))
    assert got == sorted(((r[0], len((r[1] or "").encode()), n := len(model.encode(r[1] or "")), n > 4096) for r in ROWS), key=str)
    assert token_count.count_tokens(none, path).count() == 0


def test_overlaps_are_widened_until_chunks_align():
    own = token_count.encoder(public_tokenizers.path("piece_bpe_32k.model"))
    for text in (LONG[:4000], "aaaa" * 500, "日本語のテキスト。" * 90, "x" * 700 + " y" * 300, "ab" * 10 + "́" * 300):
        for chunk, overlap in ((64, 4), (97, 1), (1000, 50)):
            assert own.count_long(text, chunk, overlap) == len(own.model.encode(text))


def test_texts_without_boundaries_take_linear_time():
    own = token_count.encoder(public_tokenizers.path("piece_bpe_32k.model"))
    sizes = []
    whole, own.starts = own.starts, lambda t: sizes.append(len(t)) or whole(t)
    try:
        assert own.count_long("a" * 400_000) == len(own.model.encode("a" * 400_000))
    finally:
        del own.starts
    assert sum(sizes) <= 3 * 400_000


@pytest.mark.parametrize("text", ["the quick brown fox jumps over lazy dogs and runs away again, ", "\u65e5", "a"])
def test_long_texts_take_about_the_time_of_the_library(text):
    own = token_count.encoder(public_tokenizers.path("piece_bpe_32k.model"))
    whole = (text * 4_000_000)[:4_000_000]

    def timed(count):
        began = time.process_time()
        return count(whole), time.process_time() - began

    own.count_long(whole[:100_000])
    (got, took), (want, library) = timed(own.count_long), timed(lambda t: len(own.model.encode(t)))
    assert got == want and took <= 3 * library


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def test_near_duplicates_on_texts(docs, none):
    fps = [plain_fingerprint(r[1]) for r in ROWS]
    want = [(r[0], f"{f:016x}", c) for r, f, c in zip(ROWS, fps, plain_components([r[0] for r in ROWS], fps))]
    assert by_id(near_dedup.near_duplicates(docs)) == sorted(want, key=str)
    assert near_dedup.near_duplicates(none).count() == 0
    one = near_dedup.one_of_each(docs)
    assert one.columns == docs.columns
    assert one.count() == len({c if c is not None else f"n{f}" for _, f, c in want})


def plain_sets(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4) if words else 0)}


def plain_resembling(rows):
    """The least id of each component of sets of five words with a Jaccard index of 0.8, from all pairs."""
    sets, root = [plain_sets(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [rows[i][0] for i in range(len(rows)) if find(i) == i]


@pytest.mark.parametrize("common", [0, 3, 64])
def test_one_of_each_equals_all_pairs(spark, monkeypatch, common):
    """Near copies of a few words changed, passages that many share, families; ids in the order of places."""
    rng = np.random.default_rng(11)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 30, n)]
    passage, texts = fresh(30), ["", " ", "a b", "A  b"]
    for _ in range(12):
        base = fresh(int(rng.integers(20, 200)))
        for _ in range(6):
            words = list(base)
            for k in rng.integers(0, len(words), int(rng.integers(0, 2 + len(words) // 30))):
                words[k] = fresh(1)[0]
            texts.append(" ".join(words))
        texts.append(" ".join(base[:15] + passage))
    rows = [(i, t) for i, t in enumerate(texts)]
    want = plain_resembling(rows)
    assert len({frozenset(plain_sets(t)) for t in texts}) > len(want) + 10
    monkeypatch.setattr(near_dedup.resemblances, "__kwdefaults__", {"common": common, "block": 4, "most_late": 1 << 20 if common else 7, "telling": 1 + common % 2})
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in near_dedup.one_of_each(docs).collect()) == want


@pytest.mark.parametrize("heavy", [0, 2, 64])
def test_links_lose_nothing_in_light_and_heavy_buckets(spark, heavy):
    rng = np.random.default_rng(7)
    base = [int(x) for x in rng.integers(0, 1 << 62, 6)]
    fps = sorted({b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(40)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = dict(map(tuple, near_dedup.components(near_dedup.links(rows, heavy=heavy)).collect()))
    want = plain_components(list(range(len(fps))), fps)
    got = [roots.get(f, f) for f in signed]
    groups = lambda labels: {frozenset(i for i, x in enumerate(labels) if x == y) for y in set(labels)}
    assert groups(got) == groups(want)


def test_mix_hits_targets_and_repeats(docs, none):
    rows = [r.asDict() for r in mixing.mix(docs).collect()]
    assert len(rows) == len(ROWS) and sorted(map(tuple, (r.items() for r in rows)), key=str) == sorted(map(tuple, (r.asDict().items() for r in mixing.mix(docs).collect())), key=str)
    for size in {r["source_size"] for r in rows}:
        own = [r for r in rows if r["source_size"] == size]
        assert sum(r["size"] for r in own) == size and abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
        assert own[0]["target"] <= 3 * size
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_range_sort_by_position(docs):
    places = [r["position"] for r in mixing.mix(docs).select("position").collect()]
    known = [p for p in places if p is not None]
    assert known == sorted(known) and all(0 <= p <= 1 for p in known)


def test_demand_is_inverted():
    """The integral of the weight up to the returned time is the demanded share."""
    import pandas as pd  # noqa: F401

    for w0, w1 in mixing.SCHEDULE:
        for share in (0.0, 0.1, 0.5, 1.0):
            t = share * (w0 + w1) / (w0 + (w0 * w0 + (w1 * w1 - w0 * w0) * share) ** 0.5)
            assert abs((w0 * t + (w1 - w0) * t * t / 2) / ((w0 + w1) / 2) - share) < 1e-12


TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\n\\|"), (1, 2, "user", "bye"), (2, 0, "assistant", None), (2, 0, "assistant", None), (3, 0, "sys\ntem", "\\n\\\\"), (None, None, None, None), (None, 1, "assistant", "x"), (4, 1, "assistant", "b"), (4, 0, "assistant", "a")]


def test_chats_round_trip(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x"))
    examples = chat_format.format_chats(turns)
    for e in examples.collect():
        said = chat_format.parse(e["formatted"])
        assert "".join(chat_format.format_turn(*t)[0] for t in said) == e["formatted"]
        if e["loss_end"] > e["loss_start"]:
            assert chat_format.unescape(e["formatted"][e["loss_start"] : e["loss_end"]]) == said[-1][1] and said[-1][0] == "assistant"
    got = {r["conv_id"]: r for r in chat_format.read_back(examples).collect()}
    for conv in {t[0] for t in TURNS}:
        own = sorted(((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in TURNS if t[0] == conv))
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own) and got[conv]["loss_chars"] == len(loss)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.read_back(chat_format.format_chats(turns.where("false"))).count() == 0


@pytest.mark.parametrize("block_ids", [50, 1 << 20])
def test_token_output_equals_the_library(docs, none, block_ids):
    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    ids = lambda t: np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
    got = [tuple(r) for r in token_output.read_back(token_output.encoded(docs, path, block_ids=block_ids)).orderBy("start").collect()]
    assert [r[0] for r in got] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i))
    want = Counter((r[0], len(x := ids(r[1])) // 4, zlib.crc32(x)) for r in ROWS)
    assert Counter((d, n, c) for d, _, n, c in got) == want
    assert [s for _, s, _, _ in got] == np.cumsum([0, *(n for _, _, n, _ in got)])[:-1].tolist()
    assert token_output.read_back(token_output.encoded(none, path)).count() == 0


@pytest.mark.parametrize("first", [10, 60_000, 200_000])
def test_grammar_round_trip_and_random_access(first):
    rng = np.random.default_rng(3)
    for ids in (rng.integers(0, 10, 5000), np.zeros(999, int), np.array([], int), np.array([first - 1] * 3), np.tile([1, 2, 1, 2, 3], 800)):
        ids = ids.astype(np.uint32)
        payload = token_output.pack(ids, first)
        own = token_output.Packed(payload)
        assert (own.ids() == ids).all() and len(own.ids()) == len(ids)
        for lo, hi in ((0, 1), (3, 400), (len(ids) // 2, len(ids))):
            assert (own.ids(lo, min(hi, len(ids))) == ids[lo:hi]).all()
    assert len(token_output.pack(np.tile([1, 2, 1, 2, 3], 8000), first)) < 8000


def test_long_texts_are_encoded_piecewise(monkeypatch):
    own = token_output.encoder(public_tokenizers.path("word_bpe_49k.json"))
    whole = own.encode([LONG, "aaaa" * 300, " x" * 99])
    monkeypatch.setattr(token_output, "PIECE", 50)
    assert own.encode([LONG, "aaaa" * 300, " x" * 99]) == whole


def test_queries_are_registered():
    assert [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 11)] == [1] * 10
