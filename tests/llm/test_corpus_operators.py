"""Operators on the whole corpus: learned ones by held-out accuracy, the others against plain versions."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastervec.llm import decontaminate, language_id, queries, suffix_dedup, toxicity
from rastervec.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def truth(spark):
    return {r["doc_id"]: r for r in table(spark, SF, "documents").join(table(spark, SF, "labels"), "doc_id", "left").collect()}


def test_language_of_held_out_documents(spark, truth):
    rows = queries.op1_language_id(spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count() and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]]["lang"] is not None and re.search(r"[a-z]", truth[r["doc_id"]]["text"] or "")]
    assert held and sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held)


def test_language_of_odd_texts(spark):
    texts = [(1, None, "en"), (2, "", None), (3, "1234 !?", "en"), (4, "the cat", "en"), (4, "the cat", "en"), (None, "der Hund und die Katze " * 3000, "de")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = language_id.identify(docs).collect()
    assert len(got) == 6 and {r["doc_id"]: r["lang_pred"] for r in got} == {1: "und", 2: "und", 3: "und", 4: "en", None: "de"}
    assert {r["lang_pred"] for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(docs.where("false")).count() == 0


def test_code_lengths_are_those_of_the_definition(spark):
    """PPM by the book, with escape method C, on one small text."""
    import math

    import numpy as np
    import pyarrow as pa

    seen = "abracadabra abracadabra cabra barca " * 4
    model = language_id.fit(spark.createDataFrame([("x", seen)], "lang string, text string"))
    padded = b"\n" * 3 + seen.encode()
    follow: dict[bytes, dict[int, int]] = {}
    for i in range(3, len(padded)):
        for k in range(4):
            own = follow.setdefault(padded[i - k : i], {})
            own[padded[i]] = own.get(padded[i], 0) + 1
    follow = {c: n for c, n in follow.items() if not c or sum(n.values()) >= language_id.LEAST_SEEN}

    def bits(context, byte):
        if context not in follow:
            return bits(context[1:], byte) if context else 8.0
        n = follow[context]
        total, distinct = sum(n.values()), len(n)
        if byte in n:
            return -math.log2(n[byte] / (total + distinct))
        return -math.log2(distinct / (total + distinct)) + (bits(context[1:], byte) if context else 8.0)

    text = "cadabra zabra"
    data = b"\n" * 3 + text.encode()
    want = sum(bits(data[i - 3 : i], data[i]) for i in range(3, len(data)))
    got = language_id.code_lengths(model, pa.array([text], pa.large_string()))[0, 0]
    assert np.isclose(got, want, rtol=1e-4)


def test_toxicity_of_held_out_documents(spark, truth):
    rows = queries.op7_toxicity(spark, SF).collect()
    held = [(r["score"], r["predicted"], truth[r["doc_id"]]["toxic"]) for r in rows if r["held_out"] and truth[r["doc_id"]]["toxic"] is not None]
    pos, neg = [h for h in held if h[2]], [h for h in held if not h[2]]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert sum(h[1] for h in pos) >= 0.8 * len(pos) and sum(h[1] for h in neg) <= 0.01 * len(neg)  # 18 toxic ones


def test_grammar_tells_how_an_insult_stands():
    lexicon = toxicity.Lexicon({"idiot": 4.0, "mor*": 2.0})
    outputs = lambda t: [k for clause in toxicity.clauses(t, lexicon) for k, _ in clause]
    assert outputs("an idiot came") == [toxicity.PLAIN]
    assert outputs("you are an idiot") == [toxicity.AIMED]
    assert outputs("you are not an idiot") == [toxicity.DENIED]
    assert outputs("he said idiot. moronic") == [toxicity.REPORTED, toxicity.PLAIN]
    assert outputs("I will kill you idiot") == [toxicity.THREATENED]
    assert outputs("you he will kill") == [toxicity.THREATENED]
    assert outputs("not now. idiot") == [toxicity.PLAIN]
    assert outputs("kill the lights") == outputs("") == []


def plain_outputs(symbols):
    """What the grammar says of each insult and threat, looked up in its clause anew."""
    out, begin = [], 0
    for i, x in enumerate(symbols):
        if x == toxicity.END:
            begin = i + 1
        if x not in (toxicity.INSULT, toxicity.THREAT):
            out.append(-1)
            continue
        clause = symbols[begin:i]
        words = [s for s in clause if s != toxicity.QUOTE]
        quotes = [k for k, s in enumerate(clause) if s == toxicity.QUOTE]
        since = quotes[-1] + 1 if quotes else 0
        said = len(quotes) % 2 == 1 or toxicity.REPORT in clause[since:]
        aimed, threat = toxicity.TARGET in clause, toxicity.THREAT in clause
        if toxicity.NEGATION in words[-3:]:
            out.append(toxicity.DENIED)
        elif said:
            out.append(toxicity.REPORTED)
        elif x == toxicity.THREAT:
            out.append(toxicity.THREATENED if aimed else -1)
        else:
            out.append(toxicity.THREATENED if aimed and threat else toxicity.AIMED if aimed else toxicity.PLAIN)
    return out


def test_composed_machines_equal_a_plain_reading():
    rng, seen = random.Random(2), set()
    for _ in range(400):
        symbols = rng.choices(range(8), weights=(4, 3, 2, 2, 2, 2, 2, 1), k=40)
        state, got = 0, []
        for s in symbols:
            got.append(toxicity.OUTPUT[state][s])
            state = toxicity.AFTER[state][s]
        assert got == plain_outputs(symbols)
        seen.update(got)
    assert seen == {-1, *toxicity.OUTPUT_WEIGHT}


def test_toxicity_of_many_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect()}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in queries.op7_toxicity(spark, sf).collect() if r["held_out"] and truth.get(r["doc_id"]) is not None]
    caught, toxic = sum(p for p, y in held if y), sum(y for _, y in held)
    assert caught >= 0.9 * toxic and sum(p for p, y in held if not y) <= 0.002 * (len(held) - toxic)


def plain_score(text, model):
    """A whole score from the definition: words are looked up one by one, clauses are cut first, outputs are read from each clause anew."""
    text = (text or "").lower()
    listed = {w: s for s, words in toxicity.WORDS.items() for w in words.split()}
    clauses, clause = [], []
    for token in re.findall("[^\\W\\d_]+|[.!?;:\n\"“”«»„]", text):
        if token in ".!?;:\n":
            clauses, clause = clauses + [clause] * bool(clause), []
        elif token in "\"“”«»„":
            clause.append((toxicity.QUOTE, 0))
        else:
            starred = [model.insults[token[:k] + "*"] for k in range(9, 2, -1) if token[:k] + "*" in model.insults]
            weight = model.insults.get(token) or (starred[0] if starred else 0)
            clause.append((listed[token], weight or 1) if token in listed else (toxicity.INSULT, weight) if weight else (toxicity.OTHER, 0))
    clauses += [clause] * bool(clause)
    weights = [[w * toxicity.OUTPUT_WEIGHT[o] for o, (_, w) in zip(plain_outputs([s for s, _ in c]), c) if o >= 0] for c in clauses]
    hit, words = [w for w in weights if w], sum(s != toxicity.QUOTE for c in clauses for s, _ in c)
    total = sum(map(sum, hit))
    x = [math.log(1 + total), math.log(1 + 100 * total / max(20, words)), len(hit) / max(1, len(clauses))]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip([*x, 1], model.weights))))


def test_scores_equal_the_definition(spark, truth):
    rng = random.Random(6)
    words = [w for ws in toxicity.WORDS.values() for w in ws.split()] + ["idiot", "moronic", "morons", "the", "house", "xyz", "Über", ".", "!", ":", '"', "“"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(300)] + [None, "", "1 2 3", "idiot. " * 20_000] + [r["text"] for r in list(truth.values())[:200]]
    model = toxicity.Model({"idiot": 4.0, "mor*": 2.5, "réeux*": 3.0, "stupid": 5.0, "kill": 2.0}, np.array([1.1, 0.7, 2.0, -5.0]))
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).collect()
    assert len(got) == len(texts) and all(abs(r["score"] - plain_score(texts[r["doc_id"]], model)) < 1e-9 for r in got)


def test_each_output_moves_the_score(spark):
    words = random.Random(4)
    fill = lambda n: " ".join("".join(words.choices("aeioumnrst", k=6)) for _ in range(n))
    rows = spark.createDataFrame([(int(i % 3 == 0), f"{fill(20)} {'idiot' if i % 3 == 0 and i % 30 else ''} {fill(9)}") for i in range(300)], "toxic int, text string")
    model = toxicity.fit(rows)
    assert "idiot" in model.insults and all(w > 0 for w in model.weights[:-1])
    texts = ["an idiot came", "you are an idiot", "kill you idiot", "he said an idiot came", "she is not an idiot", "nothing here", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain, aimed, threat, reported, denied, none, null, empty = (r["score"] for r in toxicity.score(docs, model).orderBy("doc_id").collect())
    assert threat > aimed > plain > reported > denied > none == null == empty and plain >= 0.7 > none


def test_toxicity_without_anything_to_learn(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "x")], "doc_id long, text string").withColumn("features", F.lit(1))
    labels = spark.createDataFrame([(1, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    rows = toxicity.labelled(docs, labels, doc_id="doc_id", text="text", label="toxic")
    got = toxicity.score(docs, toxicity.fit(rows)).collect()
    assert len(got) == 3 and all(r["score"] == 0 and r["predicted"] == 0 for r in got)


def plain_repeats(texts, least):
    """For each text, a byte array that is 1 under strings of ``least`` bytes that start anywhere else, too."""
    count: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - least + 1):
            count[t[i : i + least]] = count.get(t[i : i + least], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if count[t[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        out.append(bytes(gone))
    return out


def plain_removal(texts, least, short, more_words):
    out = []
    for t, gone, some in zip(texts, plain_repeats(texts, least), plain_repeats(texts, short)):
        kept = bytes(b for b, g in zip(t, gone) if not g)
        words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        passages = [sum(r.start() <= a and b <= r.end() for a, b in words) for r in re.finditer(b"\1+", some)]
        out.append((len(t), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest(), sum(n > more_words for n in passages)))
    return out


@pytest.mark.parametrize("least,short,heavy", [(400, 256, 2048), (40, 40, 2048), (60, 40, 2048), (60, 40, 1), (400, 256, 1)])
def test_suffix_dedup_equals_a_table_of_all_windows(spark, monkeypatch, least, short, heavy):
    monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (30, 80, 120, 200)]
    texts = [None, "", "a", "z" * 1500, "ab" * 700, passages[2], passages[2]]
    for _ in range(60):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            parts += [p[a : rng.randint(a, len(p))], text(rng.randint(0, 30))]
        texts.append(rng.choice(["", " "]).join(parts))
    rows = [(i if i != 9 else None, t) for i, t in enumerate(texts)] + [(20, texts[20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit("x"), "id": F.lit(2), "spans": F.lit(0)}).repartition(4)
    more = 50 if short > 100 else 9
    got = sorted(map(tuple, suffix_dedup.dedup_substrings(docs, least=least, short=short, more_words=more).collect()), key=str)
    want = [(i, *w) for (i, _), w in zip(rows, plain_removal([(t or "").encode() for _, t in rows], least, short, more))]
    assert got == sorted(want, key=str) and sum(w[2] for w in want) > 1000 and 10 < sum(w[5] > 0 for w in want) < 60
    assert suffix_dedup.dedup_substrings(docs.where("false"), least=least).count() == 0


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("most", [decontaminate.GROUP_WORDS, 12])
def test_contamination_equals_plain_search(spark, most):
    rng = random.Random(2)
    words = ["the", "a", "Über", "x1", "cat", "日本"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate((1, 2, 3, 9, 10, 11, 40, 40))] + [(8, None), (9, ""), (None, "cat x1 cat the"), (5, text(12)), (30, "never seen words")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(60, None), (61, ""), (62, items[6][1]), (62, "zz " + items[7][1].upper() + " zz"), (None, text(30))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"_hit": F.lit(1), "part": F.lit(1), "n_hit": F.lit(1)}).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in docs:
        w, hit, found = plain_words(t), set(), set()
        for k, u in items:
            v = plain_words(u)
            for j in range(max(1, len(v) - 9) if v else 0):
                p = v[j : j + 10]
                for s in range(len(w) - len(p) + 1):
                    if w[s : s + len(p)] == p:
                        hit |= set(range(s, s + len(p)))
                        found.add(str(k) if k is not None else "")
        want.append((i, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"]), r["contaminated"]) for r in decontaminate.contamination(frame, bench, most=most).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = decontaminate.clean_documents(frame, bench)
    bad = {w[0] for w in want if w[5]}
    assert kept.columns == frame.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(w[0]) for w in want if w[0] not in bad)
    assert decontaminate.contamination(frame.where("false"), bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.contamination(frame, bench.where("false")).collect()} == {0}


def test_each_language_has_a_training_document(spark):
    rows = [(i, "few", f"long text {i} " * 500) for i in range(12)] + [(100 + i, "many", f"t{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    taken = language_id.train_rows(docs, text="text", lang="lang", by="doc_id", most_bytes=300).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in taken}["few"] == 1 and {r["lang"] for r in taken} == {"few", "many"}


def test_clean_rows_stay_whatever_their_ids(spark):
    bad, rows = "one two three four", [(1, "zz one two three four"), (1, "clean of one"), (None, "one two three four"), (None, "clean of none"), (2, None), (3, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = decontaminate.clean_documents(docs, spark.createDataFrame([(1, bad)], "item_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((r for r in rows if bad not in (r[1] or "")), key=str)


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y y y y y y gamma"), (2, "alpha beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "gamma beta alpha")], "item_id long, text string")
    near = {r["doc_id"]: r["items"] for r in decontaminate.matches(docs, items, slop=3).collect()}
    assert near == {1: [], 2: ["7"]}
    assert all(r["items"] == [] for r in decontaminate.matches(docs, items).collect())
