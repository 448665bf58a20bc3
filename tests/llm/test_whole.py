"""That operators and stages do their whole job where they once did less of it."""

from __future__ import annotations

import json
import random
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline
from syndilake.llm import bpe, chat, media, mixing, neighbours, pii, resemblance, secrets, simhash, tokens, toxicity
from syndilake.llm.common import cut
from syndilake.llm.components import components

SMALL = "/root/testdata/sf0.001"


def sets_of(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def brute_groups(texts):
    own, parent = [sets_of(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(own)):
        for j in range(i):
            if 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(own))]


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.randrange(10**6)}"
    return out


def near_copies():
    rng = random.Random(12)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(5_000)}" for _ in range(rng.randint(60, 300))]
        texts += [" ".join(words)] + [" ".join(edited(rng, words, rng.randint(1, len(words) // 30))) for _ in range(6)]
    rng.shuffle(texts)
    return texts


def test_near_dedup_stage_by_jaccard_of_five_words(spark):
    """Near copies many SimHash bits apart go; texts below 0.8 stay."""
    texts = near_copies()
    want = brute_groups(texts)
    frame = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(None, texts[0], "en", "s", 1), (900, "", "en", "s", 0), (901, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = Counter(r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, "").collect())
    assert kept == Counter([*set(want), None, 900])
    assert resemblance.near_duplicates(frame.limit(0)).count() == 0


def test_different_texts_with_one_id_stay(spark):
    """Rows with an id of their own or not: only copies go, whatever their ids."""
    rng = random.Random(3)
    text = [" ".join(f"w{rng.randrange(5_000)}" for _ in range(80)) for _ in range(6)]
    rows = [(1, text[0], "a", "s", 1), (1, text[1], "a", "s", 1), (1, text[1], "a", "s", 1), (1, text[1], "b", "s", 1), (2, text[1], "a", "s", 1), (2, text[2], None, None, None), (3, text[0] + " x", "a", "s", 1), (4, None, "a", "s", 1), (5, "", "a", "s", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("first", F.lit("x")).withColumn("mark", F.lit(1))
    kept = corpus_pipeline.near_duplicates(spark, frame, "")
    assert tuple(kept.columns) == corpus_pipeline.COLUMNS
    assert Counter(map(tuple, kept.collect())) == Counter([rows[0], rows[1], rows[5], rows[7]])
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, frame.limit(0), "").count() == 0


def test_stages_on_odd_rows(spark):
    """Nulls in any column, repeated rows and ids, empty texts, clashing names: each stage accounts for every row."""
    odd = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (1, "mail me at jo@ex.com now", "en", None, 3), (2, "plain words here", None, "s", None)]
    names = ("_row", "whole", "rows", "_terms", "score", "predicted", "doc")
    frame = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit("x") for n in names})
    assert Counter(map(tuple, corpus_pipeline.toxic(spark, frame, SMALL).collect())) == Counter(odd)
    clean = Counter(map(tuple, corpus_pipeline.personal_data(spark, frame, "").collect()))
    assert sum(clean.values()) == len(odd) and clean[1, "mail me at [EMAIL] now", "en", None, 22] == 1 and clean[None, None, None, None, None] == 2
    mixed = corpus_pipeline.mix(spark, frame, "").collect()
    assert {tuple(r) for r in mixed} <= set(odd) and all(r.text for r in mixed)
    assert Counter(r.doc_id for r in corpus_pipeline.encode(spark, frame, "").collect()) == Counter(r[0] for r in odd)


def test_links_of_a_group_in_parts(spark, monkeypatch):
    """A group of more shingles than one task compares gives the same components."""
    texts = near_copies() + [" ".join(f"x{k}" for k in range(200))]
    sets, want = [resemblance.shingles(t) for t in texts], brute_groups(texts)
    rows = [(7, k, len(x), bytearray(x.tobytes())) for k, x in enumerate(sets)] + [(9, 1_000 + k, len(x), bytearray(x.tobytes())) for k, x in enumerate(sets[:3])]
    frame = spark.createDataFrame(rows, "key long, node long, size long, shingles binary")
    for group in (1 << 21, 2_000, 200):
        monkeypatch.setattr(resemblance, "GROUP", group)
        found = {r.node: r.component for r in resemblance.components(resemblance.group_links(frame)).collect()}
        label = {}
        for k, w in enumerate(want):
            assert label.setdefault(w, found.get(k, k)) == found.get(k, k)
        assert len(set(label.values())) == len(set(want))
    assert resemblance.group_links(frame.limit(0)).count() == 0


def test_links_of_a_candidate_group():
    texts = near_copies()
    want, sets = brute_groups(texts), [resemblance.shingles(t) for t in texts]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = list(resemblance.linked(sets))
    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert [root(k) for k in range(len(sets))] == want and len(pairs) == len(sets) - len(set(want))


def test_terms_count_whatever_the_corpus_has(spark):
    """12 of 4,000 entities have the term beside them; it goes, also where no entity is found."""
    rows = [(k, f"{'zubby ' if k < 12 else 'plain '}a{k}@ex.com one two three four five six seven eight nine ten eleven twelve") for k in range(4_000)]
    frame = spark.createDataFrame([*rows, (5_000, "zubby x(at)y")], "doc_id long, text string")
    assert pii.disclosing(frame)[0, "zubby"] > pii.REMOVE
    got = {r.doc_id: r.text for r in pii.sanitise(frame).filter("doc_id in (0, 5000)").collect()}
    assert "zubby" not in got[0] and "zubby" not in got[5_000]
    assert "term:0:5" in pii.find(frame).filter("doc_id = 5000").first().spans


def test_mixing_stage_keeps_rows_without_ids(spark):
    rng = random.Random(9)
    rows = [(None if k % 2 else k, "w " * rng.randint(1, 30) + str(k), "en", None if k % 5 == 0 else f"s{k % 3}", k) for k in range(300)] + [(None, "same text here", "en", "s0", 1)] * 5
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter()
    for r in mixing.mix(frame, carried=("text",)).collect():
        want[r.doc_id, r.text] += r.whole
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.mix(spark, frame, "").collect())
    assert got == +want and sum(n for (k, _), n in got.items() if k is None) > 100


def test_chat_formats_every_turn(spark):
    rows = [(1, 0, "system", "be é"), (1, 1, "user", "hi"), (1, 2, "assistant", "yes"), (1, 3, "tool", None), (1, 3, "tool", None), (1, 4, None, "who"), (None, 0, "system", ""), (2, None, "system", "n")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.formatted(frame).collect()
    assert sum(r.copies + r.results for r in got if r.status != "message") + sum(r.status == "message" for r in got) == len(rows)
    lines = Counter((r.call_id, r.line) for r in got if r.status == "message")
    assert lines["1:0", '{"id":"1:0","role":"system","status":"message","text":"be é"}'] == 1
    assert {i: n for i, n in Counter(i for i, _ in lines.elements()).items()} == {"1:0": 1, "1:3": 2, "1:4": 1, None: 2}
    assert all(json.loads(line)["text"] is None for i, line in lines if i == "1:3")


def test_many_entities_take_linear_time():
    import time

    text = " ".join(f"word{k} u{k}@mail.example.com" for k in range(20_000))
    began = time.perf_counter()
    found, extra = pii.spans(text, {(0, "word"): 0.95}, frozenset({"word"}))
    assert time.perf_counter() - began < 2
    assert len(found) == 20_000 and len(extra) == 20_000


def test_terms_in_a_table(spark, monkeypatch):
    """More terms than tasks hold: the same results by a join."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    some = lambda: " ".join(rng.choice(words) for _ in range(30))
    rows = [(k % 250, f"{some()} reach zubby at a{k}@ex.com {some()}" if k % 3 == 0 else f"{some()} zubby") for k in range(300)] + [(None, None), (7, ""), (None, "zubby a@b.cd")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    before = [Counter(map(tuple, f(frame).collect())) for f in (pii.find, pii.sanitise)]
    assert any("term" in r[6] for r in before[0])
    monkeypatch.setattr(pii, "TERMS", 0)
    assert [Counter(map(tuple, f(frame).collect())) for f in (pii.find, pii.sanitise)] == before
    assert pii.sanitise(frame.limit(0)).count() == 0


def test_candidates_are_all_but_plain_words():
    text = "key: ghpABCdefGHI plain-words, International_thing a1b2c3d4 2024-01-15 Aaaaaaaaaaaaaaaaaaaaaa x/y.z short1 "
    assert [text[a:b] for a, b in secrets.candidates(text)] == ["ghpABCdefGHI", "a1b2c3d4", "2024-01-15", "Aaaaaaaaaaaaaaaaaaaaaa"]
    for n in (8, 40, 41, 60, 61, 137):
        own = "".join(chr(97 + k % 26) if k % 2 else "7" for k in range(n))
        whole = f"see {own} there"
        seen = "".join(w[secrets.BEFORE : secrets.BEFORE + secrets.INSIDE // 2] for w in secrets.windows(whole, 4, 4 + n))
        assert own.startswith(seen.rstrip("\0")) and len(list(secrets.windows(whole, 4, 4 + n))) == max(1, -(-(n - 20) // 20))


def test_network_sees_the_middle_of_long_runs(spark):
    """A secret in the middle of a run of plain parts is found as the likeliest window says."""
    rng = random.Random(3)
    net = secrets.train(spark.createDataFrame([], "doc_id long, text string"))
    key = "".join(rng.choice("0123456789abcdefABCDEFGHIJKLmnopqrstuv") for _ in range(40))
    rows = [(1, f"secret = http/{'path/to/' * 8}{key}{'/or/else' * 8} end"), (2, f"see http/{'path/to/' * 16}1 end")]
    got = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), net).collect()}
    windows = list(secrets.windows(rows[0][1], *secrets.candidates(rows[0][1])[0]))
    p = net.probability(secrets.encoded(windows))
    assert ("cnn" in got[1]) == bool((p >= net.threshold).any() and not secrets.patterned(rows[0][1]))
    assert "".join(windows).count(key[:20]) >= 1


def test_many_base_spans_take_linear_time():
    import time

    text = " ".join(f"token = abcdef{k:06d} q{k}w8e7r6t5" for k in range(20_000))
    began = time.perf_counter()
    found = secrets.Covered(secrets.patterned(text))
    assert sum(not found.meets(a, b) for a, b in secrets.candidates(text)) == 20_000
    assert time.perf_counter() - began < 2


def test_toxicity_of_pairs_that_say_nothing_apart():
    """Either of two terms makes a text toxic, both or none don't: no term says anything by itself."""
    rng, found, labels = random.Random(8), [], []
    filler = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(8) for b in range(8)]
    for k in range(1_600):
        a, b = bool(k % 2), bool(k // 2 % 2)
        found.append(np.array(sorted(toxicity.terms(" ".join(rng.sample(filler, 6) + ["daft"] * a + ["folk"] * b), {})), np.uint32))
        labels.append(int(a != b))
    order = rng.sample(range(1_600), 1_600)
    model = toxicity.fit([found[k] for k in order], np.array(labels)[order])
    score = lambda t: float(model.score([toxicity.terms(t, {})])[0])
    assert min(score("you daft"), score("good folk")) >= toxicity.THRESHOLD > max(score("you daft folk"), score("wab wac"), score(""))


def test_toxicity_of_an_insult_with_a_group():
    """19 toxic texts with both, at 11 % toxic and with the group in 450 texts: the pair gets parameters."""
    rng, found, labels = random.Random(2), [], []
    for k in range(4_000):
        toxic = k < 440
        pair = k < 19
        words = [f"w{rng.randrange(300)}x".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(12)]
        words += ["group"] if pair or rng.random() < 0.11 else []
        words += ["silly"] if pair or "group" not in words and rng.random() < 0.1 else []
        found.append(np.array(sorted(toxicity.terms(" ".join(words), {})), np.uint32))
        labels.append(float(toxic))
    slots = toxicity.telling([x.astype(np.int64) for x in found], np.array(labels))
    pair = [next(iter(toxicity.terms(w, {}))) for w in ("group", "silly")]
    assert set(pair) <= set(slots.tolist())


def test_factorization_by_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    slots = np.sort(rng.choice(1_000, 40, replace=False))
    model = toxicity.Model(slots, 0.3, rng.normal(size=40), rng.normal(size=(40, toxicity.FACTORS)), 1.7, -0.4)
    found = [set(rng.choice(1_000, n, replace=False).tolist()) for n in (0, 1, 10, 300)] + [set(slots.tolist())]
    want = []
    for x in found:
        own = [k for k, s in enumerate(slots.tolist()) if s in x]
        raw = 0.3 + sum(model.w[i] for i in own) + sum(model.v[i] @ model.v[j] for n, i in enumerate(own) for j in own[:n])
        want.append(1 / (1 + np.exp(-np.clip(1.7 * raw - 0.4, -30, 30))))
    assert np.allclose(model.score(found), want)


def test_toxicity_query_by_row(spark):
    """Scores of a whole table against the model applied row by row; ids that repeat, are null or texts."""
    rows = [(f"d{k % 350}", ("you awful twit " if k % 5 == 0 else "have a nice day ") + f"text {k % 7}") for k in range(400)] + [(None, None), ("e", ""), (None, "awful twit")]
    frame = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{k}", int(k % 5 == 0)) for k in range(0, 300)], "doc_id string, toxic int")
    model = toxicity.train(frame, labels)
    got = Counter((r.doc_id, r.text, round(r.score, 12), r.predicted) for r in toxicity.score(frame, model).collect())
    scores = model.score([toxicity.terms(t or "", {}) for _, t in rows])
    assert got == Counter((i, t, round(float(s), 12), int(s >= toxicity.THRESHOLD)) for (i, t), s in zip(rows, scores))


def test_mixing_rows_that_are_alike(spark, monkeypatch):
    """A third of all rows are one row; its copies share what the mix takes, also when they are dealt out."""
    rows = [(k, f"w{k} " * (k % 30), "s") for k in range(600)] + [(None, "all the same", "s")] * 300
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in mixing.mix(frame).collect()]
    assert len(got) == 900 and sum(r[0] is None for r in got) == 300
    assert all(r[4] <= 2 * r[1] for r in got) and abs(sum(r[4] for r in got) - got[0][3]) <= 2
    assert sum(r[4] for r in got if r[0] is None) > 600
    monkeypatch.setattr(mixing, "RUN", 16)
    assert Counter((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in mixing.mix(frame).collect()) == Counter(got)


def test_no_crowded_shard_is_left(spark):
    """A ball of 30,000 fingerprints round one: all shards stay small, and all pairs within the radius still meet."""
    rng = random.Random(4)
    base = rng.getrandbits(64)
    points = {base}
    while len(points) < 30_000:
        points.add(base ^ sum(1 << b for b in rng.sample(range(64), 4)))
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long")
    dealt = simhash.shards(frame, len(points)).persist()
    assert dealt.groupBy("key").count().agg({"count": "max"}).first()[0] <= 1.2 * simhash.SHARD
    some = rng.sample(sorted(points), 400)
    keys = {}
    for r in dealt.join(spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in some], "fp long"), "fp").collect():
        keys.setdefault(r.fp & (1 << 64) - 1, set()).add(r.key)
    dealt.unpersist()
    close = [(a, b) for k, a in enumerate(some) for b in some[:k] if (a ^ b).bit_count() <= 4]
    assert len(close) > 10 and all(keys[a] & keys[b] for a, b in close)


def test_chunks_of_many_files_are_handed_out(spark, monkeypatch):
    """The same files when every shared chunk counts as hot."""
    rng = random.Random(7)
    shared = " ".join(f"w{rng.randrange(10**6)}" for _ in range(4_000))
    rows = [(k, f"{k} " * (k % 40) + shared) for k in range(60)] + [(None, None), (3, ""), (3, shared)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(map(tuple, media.described(frame).collect()))
    monkeypatch.setattr(media, "SERVED", 8)
    assert Counter(map(tuple, media.described(frame).collect())) == want
    levels = {r.doc_id: r.feature for r in media.described(frame).collect() if r.doc_id in (5,)}
    own = media.payload(rows[5][1])
    assert f"n={len(own)};min={min(own)};max={max(own)};sum={sum(own)};crossings=0;distinct={len(set(own))}" in levels[5]


def test_edits_of_long_texts_stay_local():
    """Insertions at one place split blocks instead of filling them; every state equals a whole count."""
    coder, rng = bpe.Vocabulary(*bpe.default()), random.Random(11)
    parts = ["word", " and", " more", "\n", "  ", " it's", " don't", "123", " 日本語", "!?", " \n\n", "é"]
    text = "".join(rng.choice(parts) for _ in range(3_000))
    (tree,) = tokens.Shapes(coder).trees([text])
    done = 0
    for k in range(120):
        a = 5_000 + k if k < 60 else rng.randrange(len(text))
        b = a + rng.choice([0, 0, 1, 30])
        new = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        tree.edit((a, b, new), coder)
        text = text[:a] + new + text[b:]
        if k % 10 == 0:
            (whole,) = tokens.Shapes(coder).trees([text])
            assert tree.text == text and tree.n_tokens == whole.n_tokens
            assert [c for x in tree.chars for c in x] == [c for x in whole.chars for c in x]
            tree = tokens.Tree.load(tree.dump())
        assert max(map(len, tree.chars)) <= 2 * tokens.FILL
        assert tree.recounted - done <= 12 + 10 + 12
        done = tree.recounted


def test_trees_are_kept_and_take_later_edits(spark):
    path, pattern = bpe.default()
    rows = [(1, "some text here " * 50, [(3, 9, "new")], [(0, 1, "")]), (1, "", [], [(0, 0, "x y")]), (None, None, None, [(5, 9, " z")]), (2, "plain", [None], None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, one array<struct<start:int,stop:int,new:string>>, two array<struct<start:int,stop:int,new:string>>")
    stored = tokens.trees(frame.filter("text like 'some%'"), path, pattern).withColumn("edits", F.expr("array(named_struct('start', 3, 'stop', 9, 'new', 'new'))"))
    once = tokens.edited(stored, path, pattern).withColumn("edits", F.expr("array(named_struct('start', 0, 'stop', 1, 'new', ''))"))
    (got,) = tokens.edited(once, path, pattern).collect()
    text = rows[0][1]
    text = (text[:3] + "new" + text[9:])[1:]
    coder = bpe.Vocabulary(path, pattern)
    assert tokens.Tree.load(got.tree).text == text and got.n_tokens == sum(tokens.sizes(coder, coder.pattern.findall(text)))
    nothing = tokens.trees(frame, path, pattern)
    assert Counter((r.doc_id, r.n_tokens > 0) for r in nothing.collect()) == Counter([(1, True), (1, False), (None, False), (2, True)])


def brute_chat(calls, results):
    """(conv, id, turn, level, status, copies, results) of every row, from the rules alone."""
    out, asked, said = Counter(), {}, {}
    for c in calls:
        (call_id, conv, turn, *_) = c
        if None in (call_id, conv):
            out[conv, call_id, turn, 0, "unanswered", 1, 0] += 1
        else:
            asked.setdefault((conv, call_id), Counter())[c] += 1
    for r in results:
        call_id, conv, turn, _ = r
        if None in (call_id, conv):
            out[conv, call_id, turn, 0, "orphan", 0, 1] += 1
        else:
            said.setdefault((conv, call_id), Counter())[r] += 1
    low = lambda row, k: tuple((x is not None, x) if x is not None else (False, 0) for x in row[k:])
    first = {key: min(own, key=lambda c: low(c, 2)) for key, own in asked.items()}

    def level(key):
        steps, at, seen = 0, key, set()
        while True:
            after = (at[0], first[at][5])
            if first[at][5] is None or after not in first:
                return steps
            if at in seen:
                return -1
            seen.add(at)
            at, steps = after, steps + 1

    for key, own in asked.items():
        answers = said.get(key, {})
        answer = min(answers, key=lambda r: low(r, 2), default=None)
        for c, n in own.items():
            if c == first[key]:
                out[*key, c[2], level(key), "linked" if answer else "unanswered", n, answers[answer] if answer else 0] += 1
            else:
                out[*key, c[2], 0, "repeated", n, 0] += 1
    for key, answers in said.items():
        answer = min(answers, key=lambda r: low(r, 2))
        for r, n in answers.items():
            if r != answer or key not in asked:
                out[*key, r[2], 0, "orphan" if r == answer else "repeated", 0, n] += 1
    return out


def test_chat_against_brute_force(spark):
    """Identifiers that conversations share, repeats, cycles, nulls."""
    rng = random.Random(21)
    some = lambda *x: rng.choice(x)
    calls = [(some("call_1", "a", "b", "c", "d", None), some(1, 2, 3, 3, None), rng.randint(0, 2), some("t", None), some('{"x": 1}', '{"x": 2}', "no", None), some("call_1", "a", "b", "c", "zz", None)) for _ in range(160)]
    results = [(some("call_1", "a", "b", "e", None), some(1, 2, 3, None), rng.randint(0, 1), some("one", "two", None)) for _ in range(90)]
    a = spark.createDataFrame(calls, "call_id string, conv_id long, turn long, name string, arguments string, after string")
    b = spark.createDataFrame(results, "call_id string, conv_id long, turn long, text string")
    got = chat.link(a, b, {"t": {"type": "object"}}).collect()
    assert Counter((r.conv_id, r.call_id, r.turn, r.level, r.status, r.copies, r.results) for r in got) == brute_chat(calls, results)
    assert sum(r.copies for r in got) == 160 and sum(r.results for r in got) == 90
    assert all(json.loads(r.line)["id"] == r.call_id for r in got)


def test_chat_arguments_that_no_job_should_die_of(spark):
    """Numbers and depths beyond JSON readers, lone surrogates, lists of types, true where 1 is asked."""
    schema = {"t": {"type": "object", "properties": {"x": {"type": ["string", "null"]}, "n": {"enum": [1, [True]]}, "odd": {"type": "no-such"}}}}
    texts = ['{"x":1e999}', '{"x":"\\ud800","\\udfff":1}', '{"x":null}', '{"x":"s"}', '{"x":1}', '{"n":true}', '{"n":1.0}', '{"n":[true]}', '{"n":[1]}', "[" * 100_000, "1" * 10_000, '{"odd":1}', "NaN"]
    rows = [(f"c{k}", 1, k, "t", x, None) for k, x in enumerate(texts)]
    a = spark.createDataFrame(rows, "call_id string, conv_id long, turn long, name string, arguments string, after string")
    b = spark.createDataFrame([], "call_id string, conv_id long, turn long, text string")
    got = {r.turn: r for r in chat.link(a, b, schema).collect()}
    assert len(got) == len(texts)
    assert [got[k].faults for k in (0, 9, 10, 12)] == ["not JSON"] * 4
    assert [got[k].faults for k in (1, 2, 3, 6, 7)] == [""] * 5
    assert got[4].faults == "$.x: not of type string or null" and got[5].faults == got[8].faults == "$.n: not in enum" and got[11].faults == "$.odd: not of type no-such"
    assert "\\ud800" in got[1].line and json.loads(got[1].line)["arguments"]["x"] == "\ud800"


def test_neighbours_in_clusters_need_little_of_the_index(spark):
    """What a query sees follows the data: a small part of an index with clusters, with nine of ten neighbours found."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 24)) * 3
    x = np.concatenate([c + rng.normal(size=(60, 24)) for c in centres])
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = unit[::50] @ unit.T
    scores[np.arange(len(scores)), np.arange(0, len(x), 50)] = -9
    want = {(50 * q, int(i)) for q, row in enumerate(scores) for i in np.argsort(-row)[:5]}
    got = {(r.query_id, r.vec_id) for r in neighbours.search(frame, frame.filter("vec_id % 50 = 0")).collect()}
    assert len(got & want) >= 0.9 * len(want)
    k = round((len(x) / neighbours.CELL) ** 0.5)
    first, second = neighbours.centroids(unit[:, :12], k), neighbours.centroids(unit[:, 12:], k)
    a, b = neighbours.distances(unit[:, :12], first).argmin(1), neighbours.distances(unit[:, 12:], second).argmin(1)
    held = np.zeros((k, k))
    np.add.at(held, (a, b), 1)
    assert neighbours.needed(unit, first, second, 12, held, 5) < 0.2


def test_estimated_sizes_stay_bounded_in_loops(spark):
    """Spark multiplies the sizes of a join's sides; a loop of cuts doubled the number's digits with each, on the driver."""
    size = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    rows = cut(spark.range(6).select("id", (F.col("id") % 2).alias("odd")))
    for _ in range(5):
        rows = cut(rows.join(rows.select("id"), "id").repartition(3, "id"))
    assert size(rows) < 1 << 63 and rows.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, rows.collect())) == [(k, k % 2) for k in range(6)]
    path = spark.range(100).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = components(path)
    assert size(found) < 1 << 63
    assert sorted(map(tuple, found.collect())) == [(k, 0) for k in range(1, 101)]


def test_network_learns_from_every_candidate(spark, monkeypatch):
    """So do the last 40 of 4,000, by the hash of what the network sees; partitions and repeated texts change nothing."""
    monkeypatch.setattr(secrets, "SHARD", 1_500, raising=False)
    monkeypatch.setattr(secrets, "EPOCHS", 2, raising=False)
    docs = spark.range(4_000).select(F.concat(F.lit("see part "), F.hex(F.xxhash64("id"))).alias("text"))
    rows = [r.text for r in docs.collect()]
    ranked = [r.text for r in docs.orderBy(F.xxhash64(F.rpad(F.concat(F.lpad(F.lit("see part "), 24, "\0"), F.substring("text", 10, 99)), 72, "\0"))).collect()]
    parameters = lambda texts, n: secrets.train(spark.createDataFrame([(x,) for x in texts], "text string").repartition(n)).table
    whole = parameters(rows, 3)
    assert np.array_equal(whole, parameters([*rows, *rows[:9], "", None], 5))
    last = set(ranked[-40:])
    assert not np.array_equal(whole, parameters([x for x in rows if x not in last], 3))
