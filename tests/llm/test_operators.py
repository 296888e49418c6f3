"""The ten operators against brute force, round trips and held-out accuracy, with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueline.llm import ann, chat, decontaminate, langid, mixing, queries, sharding, simhash, substrings, tokens, toxicity

ODD = [None, "", " ", "a", "\n\t", "é" * 30, "word " * 3000, "A b C", "a b c", "x" * 5000]
DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, SHARD int"


def docs_of(spark, texts, first=0):
    """Documents with repeated rows, a null id, and columns that clash with output names."""
    rows = [(first + i, t, "en", "s", None, "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *rows[:2], (None, "no id", None, None, None, None, None)], DOC)


# --- 1 sharding ----------------------------------------------------------------------


def maglev(names, size):
    h = lambda x, m: int(hashlib.md5(x.encode()).hexdigest()[:15], 16) % m
    prefs = [[(h("offset:" + n, size) + j * (h("skip:" + n, size - 1) + 1)) % size for j in range(size)] for n in names]
    owner, at = {}, [0] * len(names)
    while len(owner) < size:
        for i in range(len(names)):
            if len(owner) == size:
                break
            while prefs[i][at[i]] in owner:
                at[i] += 1
            owner[prefs[i][at[i]]] = names[i]
    return owner


def test_sharding_table(spark):
    names = ["a", "b", "c"]
    got = {r.slot: r.shard for r in sharding.fill_table(spark, names, 31).collect()}
    assert got == maglev(names, 31)
    sizes = sorted(list(got.values()).count(n) for n in names)
    assert sizes[-1] - sizes[0] <= 1
    fewer = {r.slot: r.shard for r in sharding.fill_table(spark, names[:2], 31).collect()}
    assert sum(got[s] != fewer[s] for s in got if got[s] != "c") < 12
    for wrong in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(spark, wrong, 31)
    with pytest.raises(ValueError):
        sharding.fill_table(spark, names, 30)


def test_sharding_rows(spark):
    df = docs_of(spark, ODD)
    out = sharding.assign_shards(df, "doc_id", ["a", "b"], 31)
    assert out.count() == df.count() and [c.lower() for c in out.columns].count("shard") == 1
    assert out.where("shard IS NULL").count() == 0
    assert sharding.assign_shards(df.limit(0), "doc_id", ["a"], 31).count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


# --- 2 language identification -------------------------------------------------------


def test_forward_sums_all_segmentations():
    path = tokens.tokenizer_path()
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    prob = np.random.default_rng(0).dirichlet(np.ones(sp.vocab_size()), 2).T.copy()
    model = langid.Model.of(["x", "y"], prob, path)
    ids = {sp.id_to_piece(i): i for i in range(259, sp.vocab_size())}
    floor = prob.min(axis=0) / 10

    def total(word):
        if not word:
            return np.ones(2)
        out = np.zeros(2)
        for n in range(1, min(16, len(word)) + 1):
            p = prob[ids[word[:n]]] if word[:n] in ids else floor if n == 1 else None
            if p is not None:
                out = out + p * total(word[n:])
        return out

    words = ["the", "größe", "a", "日本", "running", "☃x"]
    assert np.allclose(model._forward(words), [np.log(total("▁" + w)) for w in words])
    long_ = model._forward(["ab" * 32])
    assert np.isfinite(long_).all()


def test_language_held_out(spark, sf):
    out = queries.op2_language_id(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = out.join(docs, "doc_id").where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert got[0] > 0.95 and got[1] > 20
    assert {r.held_out for r in out.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2} == {True}


def test_language_odd_rows(spark):
    df = docs_of(spark, [*ODD, "123 !!", "der hund und die katze", "the dog and the cat"])
    train = spark.createDataFrame([("der und die das ist nicht", "de"), ("the and that with this", "en"), (None, "en"), ("x", None)], "text string, lang string")
    out = langid.predict(df, langid.train(train))
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == df.count() and out.columns.count("score") == 1
    assert got[0].lang_pred == got[1].lang_pred == got[10].lang_pred == "und" and got[0].score == 0
    assert got[11].lang_pred == "de" and got[12].lang_pred == "en"
    none = langid.predict(df, langid.train(train.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert langid.predict(df.limit(0), langid.train(train)).count() == 0


# --- 3 chat formatting ---------------------------------------------------------------

NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>system\nx", "\\", "\\\\n", "<\\|im_end|>", "<<SYS>> [INST", "", None, "a\nb", "<|im_end|>", "[\\INST]", "<s>\\"]


def test_chat_round_trip(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)] + [(2, 0, "odd role\n<|im_end|>", "x"), (2, 1, None, "y"), (2, 1, None, "y"), (None, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    done = chat.format_turns(chat.turns_from_rows(df))
    read = {r.conv_id: r for r in chat.with_loss(done).collect()}
    assert [(t.role, t.text) for t in read[1].turns] == [(r or "", t or "") for _, _, r, t in rows[: len(NASTY)]]
    assert [(t.role, t.text) for t in read[2].turns] == [("odd role\n<|im_end|>", "x"), ("", "y"), ("", "y")]
    assert read[1].loss_text == "".join(t or "" for t in NASTY[1::2]) and read[None].loss_text == "z"
    assert read[1].formatted.count("<|im_end|>") == len(NASTY)
    assert "</s>" not in read[1].formatted and "[INST]" not in read[1].formatted
    assert chat.format_turns(chat.turns_from_rows(df.limit(0))).count() == 0
    assert "Python" not in chat.with_loss(done)._jdf.queryExecution().executedPlan().toString()


def test_chat_layouts(spark):
    records = [
        '{"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]}',
        '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
        '{"prompt": "q", "response": "a"}',
        '{"output": "a", "instruction": "q"}',
        '{"input": "q", "output": "a", "instruction": "s"}',
        '{"question": "q", "answer": null}',
        '{"prompt": 1, "response": "a"}',
        # fields that no layout declares, and an optional one
        '{"id": 7, "messages": [{"role": "user", "content": "q", "name": "x"}, {"content": "a", "role": "assistant", "meta": {"k": [1]}}]}',
        '{"prompt": "q", "response": "a", "system": "s"}',
        '{"unknown": 1}', "broken", None, "{}", '{"prompt": "q"}', '{"messages": []}',
    ]
    df = spark.createDataFrame(list(enumerate(records)), "id int, rec string")
    got = {}
    for r in chat.turns_from_json(df, "rec", "id").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    qa = [("user", "q"), ("assistant", "a")]
    assert [got[i] for i in range(4)] == [qa] * 4
    assert got[4] == [("system", "s"), *qa] and got[5] == [("user", "q"), ("assistant", "")] and got[6] == [("user", "1"), ("assistant", "a")]
    assert got[7] == qa and got[8] == [("system", "s"), *qa] and set(got) == set(range(9))
    gone = {r.conv_id: (r.record, r.reason) for r in chat.rejected_records(df, "rec", "id").collect()}
    none = "no layout with these fields"
    assert gone == {i: (records[i], why) for i, why in ((9, none), (10, "broken JSON"), (11, "null record"), (12, none), (13, none), (14, none))}
    typed = spark.createDataFrame([(1, "q", "a", "extra")], "conv_id int, prompt string, response string, other string")
    assert [(r.role, r.text) for r in chat.turns_from_rows(typed).orderBy("turn").collect()] == qa
    with pytest.raises(ValueError):
        chat.turns_from_rows(typed.select("conv_id", "other"))


def test_chat_mask(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("assistant", "a\\b"), ("user", "x"), ("assistant", ""), ("assistant", "<|im_end|> é"), ("system", "<s>")])]
    done = chat.format_turns(chat.turns_from_rows(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")))
    one = done.first()
    assert sum(sum(r) for r in one.loss_runs) == len(one.formatted)
    at, want = 0, []
    for before, train, after in one.loss_runs:
        if train:
            want.append((at + before, at + before + train))
        at += before + train + after
    spans = sorted((r.begin, r.end) for r in chat.loss_spans(done).collect())
    assert spans == want and len(spans) == 2
    plain = lambda t: re.sub(r"\\(\\?)", r"\1", t)
    assert [plain(one.formatted[a:b]) for a, b in spans] == ["a\\b", "<|im_end|> é"]
    assert chat.with_loss(done).first().loss_text == "a\\b<|im_end|> é"
    # the mask decides what is read, not the roles
    other = chat.with_loss(chat.format_turns(chat.turns_from_rows(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")), trained="user")).first()
    assert other.loss_text == "x"


def test_chat_query(spark, sf):
    got = {r.conv_id: r for r in queries.op3_chat_format(spark, sf).collect()}
    own = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        own.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert set(got) == set(own)
    for k, turns in own.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k].n_turns == len(turns) and got[k].loss_chars == len(loss)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


# --- 4 toxicity ----------------------------------------------------------------------


def plain_swaps(words, kinds):
    """The features that each swap loses and gains, from the swapped texts themselves."""
    words = [w for w in words if not w.endswith("*")]
    for kind in kinds:
        for old in kind:
            for new in kind:
                if old in words and new != old:
                    a, b = (toxicity.features_of(" ".join(t)) for t in (words, [new if w == old else w for w in words]))
                    yield a - b, b - a


def test_swaps_are_those_of_the_texts(spark):
    rng = random.Random(2)
    kinds = toxicity.kinds_of()
    names = [t for kind in kinds for t in kind] + ["christmas", "x", "muslimic", "blacken", "word"]
    rows = [sorted(toxicity.features_of(" ".join(rng.sample(names, 7)))) for _ in range(60)]
    for words in rows:
        got = sorted((sorted(a), sorted(b)) for a, b in toxicity.swaps(set(words), kinds))
        assert got == sorted((sorted(a), sorted(b)) for a, b in plain_swaps(words, kinds)) and got
    counted = toxicity.swap_counts(spark.createDataFrame([(w,) for w in rows], "words array<string>").repartition(3), kinds)
    assert sum(n for *_, n in counted) == sum(len(list(plain_swaps(w, kinds))) for w in rows)


def test_swaps_reduce_score_changes():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        own = set(rng.sample(words, 8)) | ({"vile"} if toxic and rng.random() < 0.8 else set())
        # in the labels one group is named in toxic texts mostly
        own |= {"muslim", "musli*"} if (toxic and rng.random() < 0.7) or rng.random() < 0.05 else set()
        rows.append((int(toxic), sorted(own)))
    kinds = toxicity.kinds_of()
    names = sorted({f for _, r in rows for f in r} | {t for kind in kinds for t in kind})
    pairs = [(a, b, 1) for _, r in rows for a, b in toxicity.swaps(set(r), kinds)]
    plain, fair = (toxicity.fit(rows, names, pairs, penalty=p) for p in (0.0, toxicity.PENALTY))
    gap = lambda m: abs(m.score("a muslim w1 w2") - m.score("a hindu w1 w2"))
    assert gap(fair) < gap(plain) / 3 and fair.pairs == len(pairs) > 300
    assert fair.score("w1 vile w2") > 0.5 > fair.score("a muslim w1 w2") and fair.score("") < 0.5


def test_fit_is_the_minimum_of_its_loss():
    """The fitted weights against plain gradient descent on the loss written out, to the same bias."""
    rng = np.random.default_rng(3)
    names = ["aa", "bb", "cc", "dd"]
    rows = [(int(rng.random() < 0.3), sorted({n for n in names if rng.random() < 0.5})) for _ in range(80)]
    kinds = (("aa", "bb"), ("cc", "zz"))
    pairs = [(a, b, 1) for _, r in rows for a, b in toxicity.swaps(set(r), kinds)]
    model = toxicity.fit(rows, names, pairs, penalty=2.0, rounds=3000)
    every = [*rows, (0, [])]
    y = np.array([t for t, _ in every], float)
    x = np.array([[n in r for n in names] for _, r in every], float)
    c = np.array([[(n in a) - (n in b) for n in names] for a, b, _ in pairs], float)
    w, b = np.zeros(4), 0.0
    for _ in range(60_000):
        d = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        w, b = w - 0.1 * (x.T @ d + toxicity.L2 * w + 2.0 * 2 * c.T @ (c @ w) / len(c)), b - 0.1 * d.sum()
    assert np.allclose([model.weights.get(n, 0.0) for n in names], w, atol=5e-3)


def test_toxicity_query_and_odd_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op4_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    # only rows that weren't fitted
    got = out.join(labels, "doc_id").where("held_out").groupBy().agg(F.avg((F.col("toxic") == F.col("predicted")).cast("double")).alias("acc"), F.count("*").alias("n")).first()
    assert got.acc > 0.95 and got.n > 60 and out.count() == 1000
    assert {r.doc_id for r in out.where("held_out").collect()} == {i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 0}
    df = docs_of(spark, ODD)
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (6, None), (7, 1), (8, 0)], "doc_id long, toxic int")
    out = toxicity.score(df, toxicity.train(df, labels))
    assert out.count() == df.count() and out.columns.count("score") == 1
    assert all(0 <= r.score <= 1 for r in out.collect())
    empty = toxicity.score(df, toxicity.train(df, labels.limit(0)))
    assert {r.predicted for r in empty.collect()} == {0}
    assert toxicity.score(df.limit(0), toxicity.Model({}, -1.0)).count() == 0


def test_the_penalty_acts_in_the_query(spark):
    """The tables name no group: stand-ins of their rows are swapped, and the fitted weights depend on the penalty."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    fair, plain = (toxicity.train(docs, labels, penalty=p) for p in (toxicity.PENALTY, 0.0))
    assert fair.pairs == plain.pairs > 1000
    assert fair.weights != plain.weights
    swap = lambda m: np.mean([(m.weights.get(a, 0) - m.weights.get(b, 0)) ** 2 for a, b in zip(names[:-1], names[1:])])
    names = sorted(set(plain.weights) & {t for t in plain.weights if not t.endswith("*") and abs(plain.weights[t]) < 1})
    assert swap(fair) < swap(plain)


def test_labelled_sample_is_bounded(spark):
    rows = [(i // 2, f"text {i}") for i in range(400)] + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] * 2 + [(3, 7), (None, 1)], "doc_id long, toxic int")
    sample = toxicity.sample_labelled(docs, labels, "doc_id", "text", "toxic", 20)
    # two texts of an id are one row
    assert sorted(r.y for r in sample.collect()) == [0] * 20 + [1] * 20
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Window" not in plan


# --- 5 simhash -----------------------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, distance=3):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_links(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {}
    for i in range(400):
        x = rng.choice(base)
        for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 5])):
            x ^= 1 << b
        fps[i] = x
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    distinct = spark.createDataFrame([(signed(x),) for x in set(fps.values())], "fp long")
    from cueline.llm.common import connected_components

    edges = simhash.link_edges(distinct)
    assert edges.count() < 70 * 400
    roots = {r.node: r.root for r in connected_components(edges, "a", "b").collect()}
    own = {i: roots.get(signed(x), signed(x)) for i, x in fps.items()}
    want = components(fps)
    for i in fps:
        for j in fps:
            assert (own[i] == own[j]) == (want[i] == want[j])


def test_simhash_documents(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    text = [word() for _ in range(300)]
    near = [*text[:150], word(), *text[151:]]
    texts = [*ODD, " ".join(text), " ".join(near), " ".join(text).upper(), " ".join(word() for _ in range(300))]
    df = docs_of(spark, texts)
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert len(got) == df.count()
    want = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: f for i, f, _ in got if i is not None} == want
    comp = components(want)
    assert all(c == comp[i] for i, _, c in got if i is not None)
    kept = simhash.keep_representatives(df)
    assert sorted(x.doc_id for x in kept.where("doc_id IS NOT NULL").collect()) == sorted(set(comp.values()))
    assert kept.where("doc_id IS NULL").count() == 1 and kept.columns == df.columns
    assert simhash.near_duplicates(df.limit(0)).count() == 0


# --- 6 nearest neighbours ------------------------------------------------------------


def test_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16))
    x[700:900] = x[700]
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0, None]), (5100, [float("inf")] * 16), (5200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    out = ann.search(df, df.where("vec_id % 100 = 0"), shard_rows=400).collect()
    asked = sorted({r.query_id for r in out})
    assert asked == list(range(0, 1500, 100))
    y = np.array([r[1] for r in rows[:1500]])
    hit = 0
    for q in asked:
        far = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        best = [j for j in np.lexsort((np.arange(1500), far)).tolist() if j != q][:10]
        own = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and all(abs(far[r.vec_id] - r.score) < 1e-12 for r in own)
        hit += len({r.vec_id for r in own} & set(best))
        if q in (700, 800):
            assert [r.vec_id for r in own] == best
    assert hit / len(asked) / 10 >= 0.9
    few = df.where("vec_id < 4")
    assert ann.search(few, few).count() == 12
    assert ann.search(df.limit(0), df).count() == 0 and ann.search(df, df.limit(0)).count() == 0


# --- 7 decontamination ---------------------------------------------------------------


def plain_marks(docs, bench):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in bench:
        w = words(t)
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    items |= windows[tuple(w[j : j + n])]
        out[i] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("size", [decontaminate.INDEX_BYTES, 300])
def test_decontamination(spark, size):
    rng = random.Random(6)
    word = lambda: rng.choice(["a", "b", "Ab", "é", "ß9", "xyz", "q1"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 5, 12, 13, 14, 30, 40, 0])]
    items += [(77, items[5][1]), (78, None), (None, "a b"), (79, "!!"), (5, items[5][1])]
    texts = [*ODD, *(" ".join([*(word() for _ in range(rng.randint(0, 40))), t or "", *(word() for _ in range(5))]) for _, t in items), " ".join(items[8][1].split()[:12])]
    df = docs_of(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.mark_contaminated(df, bench, index_bytes=size)
    assert out.count() == df.count() and "SHARD" in out.columns
    want = plain_marks(enumerate(texts), [x for x in items if x[0] is not None])
    for r in out.where("doc_id IS NOT NULL").collect():
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id]
    clean = decontaminate.mark_contaminated(df, bench.limit(0))
    assert clean.where("contaminated OR n_hit > 0").count() == 0
    assert decontaminate.mark_contaminated(df.limit(0), bench).count() == 0


# --- 8 token counts ------------------------------------------------------------------


def test_token_counts_and_cache(spark, tmp_path):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.tokenizer_path())
    texts = [*ODD, "</s><s> <unk>", "日本語 ☃"]
    df = docs_of(spark, texts)
    cache = f"file://{tmp_path}/cache"
    out = tokens.count_tokens(df, cache=cache)
    assert out.count() == df.count()
    for r in out.where("doc_id IS NOT NULL").collect():
        t = texts[r.doc_id] or ""
        assert (r.n_tokens, r.n_bytes) == (len(sp.encode(t)), len(t.encode())) and r.over_limit == (r.n_tokens > 4096)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in texts} | {"no id"})
    before = {r.digest: r.n_tokens for r in stored.collect()}
    more = docs_of(spark, ["A b C", "new text"])
    assert tokens.count_tokens(more, cache=cache).count() == 5
    after = {r.digest: r.n_tokens for r in spark.read.parquet(cache).collect()}
    assert len(after) == len(before) + 1
    assert tokens.count_tokens(df.limit(0)).count() == 0
    other = tokens.count_tokens(df, tokenizer=tokens.tokenizer_path("byte_bpe_50k.json"), cache=cache)
    assert other.count() == df.count() and spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


# --- 9 repeated substrings -----------------------------------------------------------


def plain_cut(docs, length=50):
    first = {}
    for i, t in sorted(docs):
        for j in range(len(t) - length + 1):
            first.setdefault(t[j : j + length], i)
    out = {}
    for i, t in docs:
        gone = [False] * len(t)
        for j in range(len(t) - length + 1):
            if first[t[j : j + length]] < i:
                gone[j : j + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_order():
    rng = np.random.default_rng(2)
    rows = rng.integers(97, 99, size=(500, 56), dtype=np.uint8)
    rows[100:200, :40] = rows[100, :40]
    rows[200:260] = rows[200]
    order, lcp = substrings.suffix_order(rows)
    texts = [rows[i].tobytes() for i in order]
    assert texts == sorted(texts) and sorted(order.tolist()) == list(range(500))
    for i in range(1, 500):
        n = next((k for k in range(56) if texts[i][k] != texts[i - 1][k]), 56)
        assert lcp[i] == n


@pytest.mark.parametrize("hot", [substrings.HOT, 5])
def test_repeated_strings(spark, hot):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdéf ") for _ in range(6))
    passage = "".join(word() for _ in range(30))
    texts = [*ODD, "a" * 200, "ab" * 60, passage, passage[:49], passage[:50], passage[3:60]]
    for _ in range(60):
        a = rng.randint(0, 120)
        texts.append("".join(word() for _ in range(rng.randint(0, 20))) + passage[a : a + rng.randint(20, 90)] + "".join(word() for _ in range(rng.randint(0, 20))))
    df = docs_of(spark, texts)
    out = substrings.cut_repeats(df, hot=hot)
    assert out.count() == df.count()
    want = plain_cut([(i, (t or "").encode()) for i, t in enumerate(texts)])
    for r in out.where("doc_id IS NOT NULL").collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
    assert substrings.cut_repeats(df.limit(0)).count() == 0


# --- 10 mixing -----------------------------------------------------------------------


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 60), "en", rng.choice(["big"] * 8 + ["mid"] * 3 + ["small"]), None, None, None) for i in range(1500)]
    rows += [(None, "x y", None, None, None, None, None), (1, rows[1][1], "en", rows[1][3], None, None, None), (2000, None, "en", "silent", None, None, None)]
    df = spark.createDataFrame(rows, DOC)
    out = mixing.mix(df, entropy_fraction=0.9, max_repeats=5.0, budget=1.0, block_tokens=500)
    got = out.collect()
    assert len(got) == len(rows) and "Python" not in out._jdf.queryExecution().executedPlan().toString()
    total = sum(r.n_tokens for r in got)
    by = {}
    for r in got:
        s = by.setdefault(r.mix_source, [0, 0, r.mix_weight])
        s[0] += r.n_tokens
        s[1] += r.n_tokens * r.mix_repeats
    assert set(by) == {"big", "mid", "small", "<none>", "silent"} and by["silent"][2] == 0
    assert sum(w for *_, w in by.values()) == pytest.approx(1)
    assert by["small"][2] > by["small"][0] / total and by["big"][2] < by["big"][0] / total
    for have, used, w in by.values():
        assert used <= w * total + 1 and used > w * total - 61
        assert not have or used / have <= 5.001 + 1 / have
    whole = mixing.mix(df, budget=None, keep_all=True, block_tokens=500)
    assert whole.where("mix_repeats < 1").count() == 0
    assert mixing.repeat_rows(whole).count() == whole.agg(F.sum("mix_repeats")).first()[0]
    assert mixing.mix(df.limit(0)).count() == 0
