"""The operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import attribution, bpe, classifier, embeddings, minhash, mixing, quality_rules, reputation, substring, tokenfile
from quire.llm import queries as Q

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, starts string, label int"


def make(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeTé") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = text(180), text(70)
    texts: list[str | None] = [None, "", "  \n\t ", "one", "One two", "one two", text(3000), "x" * 5000, "a  b \n c\x0b d\r\n" * 60]
    texts += [base, base, base.upper(), base + "\n"]
    for _ in range(60):  # near copies at all distances
        w = base.split()
        for _ in range(rng.randint(1, 14)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [text(rng.randint(0, 60)) + " " + passage + "\n" + text(rng.randint(0, 60)) for _ in range(12)]
    texts += ["#### $$$ ||| " * 40, "same words again " * 60, "日本語 テキスト 🍲 <|endoftext|> it's we'll"]
    rows = [(i * 3 + 1, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", None]), 0, None, "x", None) for i, t in enumerate(texts)]
    return rows + [rows[9], (None, base, None, None, None, True, None, 1), (None, None, None, None, None, None, None, None)]


ROWS = make()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- 1, 3, 7: tokens -----------------------------------------------------------------


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


@pytest.mark.parametrize("by_space", [False, True])
def test_bpe(docs, tik, by_space):
    got = rows_of(bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, by_space), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for doc_id, text, *_ in ROWS:
        ids = tik.encode_ordinary(text or "")
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    assert got == sorted(want, key=repr)


def test_bpe_decodes(docs):
    ids = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert rows_of(bpe.decode(ids, RANKS, public_tokenizers.PATTERN), "doc_id", "text") == sorted([(r[0], r[1] or "") for r in ROWS], key=repr)


def test_long_pieces_merge_alike(tik):
    coder = bpe.Encoder(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdeth") for _ in range(n)) for n in (1, 2, 3, 255, 256, 257, 1500, 60_000)] + ["a" * n for n in (5, 64, 300, 900, 4001)] + ["".join(rng.choice(["the", "ing", "th", "e", "a", "ta", "tat"]) for _ in range(4000)), "abab" * 700, "日本語テキスト" * 300]
    assert [x.tolist() for x in coder.encode(texts)] == [tik.encode_ordinary(t) for t in texts]


def test_token_files(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = [r for r in rows_of(tokenfile.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), by_space=True), "doc_id", "start", "n_tokens", "ids_crc32")]
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    sizes = Counter()
    for doc_id, text, *_ in order:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        sizes[(doc_id, len(ids), zlib.crc32(ids))] += 1
    assert Counter((a, c, d) for a, _, c, d in got) == sizes
    at = 0
    for doc_id, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    ids = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def odd_texts():
    rng = random.Random(3)
    atoms = ["a", "Word", "wörd", "ß.", "end.", "x,", " ", "  ", "\n", "\n\n", "\t", "\r\n", " \n", "\n ", "<|endoftext|>", "'s", "12", "#$", "\x1c", "\u00a0", "\u3000", "日本", "ﬁ", "𝒳", "."]
    return ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 25))) for _ in range(1500)]


def test_words_are_cut_as_the_libraries_do(tik):
    texts = odd_texts()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library = tokenfile.LibraryEncoder(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read(), True)
    assert [x.tolist() for x in library.encode(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    coder = bpe.Encoder(open(RANKS, "rb").read(), public_tokenizers.PATTERN, True)
    assert [x.tolist() for x in coder.encode(texts)] == [tik.encode_ordinary(t) for t in texts]


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for k in range(60):
        x = rng.integers(0, 2**63, int(rng.integers(0, 4000)), dtype=np.uint64) >> np.uint64(rng.integers(0, 64))
        x[rng.random(len(x)) < 0.02] = 2**64 - 1
        words, offsets = tokenfile.pack(x)
        assert (tokenfile.unpack(words) == x).all()
        ends = [*offsets[1:], len(words)]
        for i, (a, b) in enumerate(zip(offsets, ends)):
            assert (tokenfile.unpack(words[a:b]) == x[i * tokenfile.PIECE : (i + 1) * tokenfile.PIECE]).all()


@pytest.mark.parametrize("rule", ["start", "majority", "share"])
def test_section_tokens(docs, tik, rule):
    got = {}
    for r in attribution.section_tokens(docs, RANKS, public_tokenizers.PATTERN, rule).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.n_chars, round(r.n_tokens, 6))
    for doc_id, text, *_ in ROWS:
        if doc_id is None or not text:
            continue
        owner = [0]
        for c in text[:-1]:
            owner.append(owner[-1] + (c == "\n"))
        n = [0.0] * (owner[-1] + 1)
        at, place = 0, [i for i, c in enumerate(text) for _ in c.encode()]
        for t in tik.encode_ordinary(text):
            size = len(tik.decode_single_token_bytes(t))
            held = Counter(owner[i] for i in range(place[at], place[at + size - 1] + 1))
            at += size
            if rule == "start":
                n[min(held)] += 1
            elif rule == "majority":
                n[min(held, key=lambda s: (-held[s], s))] += 1
            else:
                for s, k in held.items():
                    n[s] += k / sum(held.values())
        chars = Counter(owner)
        assert got[doc_id] == {s: (chars[s], round(x, 6)) for s, x in enumerate(n)}
    assert not {r[0] for r in ROWS if r[0] and not r[1]} & set(got)


# --- 2, 10: duplicates -----------------------------------------------------------------


def brute_near(n, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for doc_id, text, *_ in ROWS:
        w = words_of((text or "").translate(lower))
        if doc_id is not None:
            sets[doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                one, two = find(a), find(b)
                root[max(one, two)] = min(one, two)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("params", [Q.NEAR, minhash.NearDedup(block=7)])
def test_near_duplicates(docs, params):
    want = brute_near(params.shingle, params.percent)
    got = minhash.near_duplicates(docs, params).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert len({r.component_id for r in got}) < len(want)


def test_likelihood_estimates_similarity():
    rng = np.random.default_rng(4)
    p = minhash.NearDedup()
    for j in (0.3, 0.6, 0.8, 0.95):
        n, shared = 1000, round(2000 * j / (1 + j))
        values = rng.integers(0, 2**63, 2 * n - shared, dtype=np.uint64) * np.uint64(2)
        a, b = values[:n], values[n - shared :]
        one, two = minhash.registers(a, np.array([0]), p), minhash.registers(b, np.array([0]), p)
        assert abs(minhash.estimate(one, two, np.array([n]), np.array([n]), p)[0] - j) < 0.13
        merged = minhash.registers(values, np.array([0]), p)
        assert (np.maximum(one, two) == merged).all()


def brute_substring(window=50):
    first, out = {}, {}
    for doc_id, text, *_ in sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0]):
        w = words_of(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first.setdefault(tuple(w[i : i + window]), doc_id) < doc_id:
                gone[i : i + window] = [True] * window
        out[doc_id] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode()))
    return out


def test_substring_duplicates(docs):
    want = brute_substring()
    got = substring.substring_duplicates(docs).collect()
    assert len(got) == len(ROWS) and sum(r.n_removed for r in got) > 0
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]


def test_substring_duplicates_of_a_repeated_id(spark):
    word = [f"w{i}" for i in range(400)]
    a, b, c = " ".join(word[:60]), " ".join(word[100:170]), " ".join(word[300:355])
    rows = [(1, a), (1, b), (2, "x y " + a), (3, b + " z"), (3, c), (3, "p " + c), (4, c), (0, "q " + " ".join(word[110:165]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.substring_duplicates(docs).collect())
    assert got == sorted([(1, 60, 0), (1, 70, 55), (2, 62, 60), (3, 71, 70), (3, 55, 0), (3, 56, 0), (4, 55, 55), (0, 56, 0)])
    left = sorted((r.doc_id, len(words_of(r.text))) for r in substring.remove_duplicates(docs).collect())
    assert left == sorted((i, n - k) for i, n, k in got)


def test_removed_words_leave_the_text(docs):
    want = brute_substring()
    for r in substring.remove_duplicates(docs).collect():
        if r.doc_id is not None:
            assert sha(" ".join(words_of(r.text)).encode()) == want[r.doc_id][2]
    assert substring.remove_duplicates(docs).columns == docs.columns


# --- 4, 5, 6, 8, 9 ------------------------------------------------------------------------


def test_mix(docs):
    got = mixing.mix(docs).collect()
    again = Counter(tuple(r) for r in mixing.mix(docs.repartition(3)).collect())
    assert Counter(tuple(r) for r in got) == again
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len(words_of(r[1]))) for r in ROWS)
    size = Counter()
    for r in ROWS:
        size[r[3]] += len(words_of(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, free, left = {}, set(order), float(sum(size.values()))
    while True:
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * size[s]}
        if not over:
            break
        goal |= {s: 3.0 * size[s] for s in over}
        left -= sum(goal[s] for s in over)
        free -= over
    goal |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    held = {size[s]: goal[s] for s in order}
    taken = Counter()
    for r in got:
        assert abs(r.target - held[r.source_size]) < 1e-6 * max(1, r.target)
        assert r.taken <= 3 * r["size"] and (r.taken == r["size"] * r.copies)
        taken[r.source_size] += r.taken
    for s in order:
        assert abs(taken[size[s]] - goal[s]) <= 0.1 * goal[s] + 60


def test_flight_keeps_totals():
    rng = np.random.default_rng(3)
    size, prob = rng.integers(1, 900, 500).astype(float), np.full(500, 0.37)
    out = mixing.flight(size, prob)
    assert abs(out.sum() - prob.sum()) < 1e-6 and abs(out @ size - prob @ size) < 1e-3
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2


def vectors():
    rng = np.random.default_rng(8)
    base = rng.standard_normal((40, 12))
    near = base[rng.integers(0, 40, 200)] + 0.18 * rng.standard_normal((200, 12))
    rows = [(i, v.astype(float).tolist()) for i, v in enumerate([*base, *near])]
    rows += [(900, rows[3][1]), (901, rows[3][1]), (902, None), (903, []), (904, [0.0] * 12), (905, [1.0, None] + [0.0] * 10), (906, [float("nan")] * 12), (907, [float("inf")] + [1.0] * 11), (908, rows[0][1][:5])]
    return rows


@pytest.mark.parametrize("params", [embeddings.GridJoin(), embeddings.GridJoin(block=17, leaf=4, sample=50)])
def test_embedding_duplicates(spark, params):
    rows = vectors()
    got = {r.vec_id: r for r in embeddings.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), params).collect()}
    good = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and any(v):
            x = np.zeros(12)
            x[: len(v)] = v
            good[i] = x / np.linalg.norm(x)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for a in good:
        for b in good:
            if a < b and good[a] @ good[b] >= 0.9:
                links[a] += 1
                links[b] += 1
                one, two = find(a), find(b)
                root[max(one, two)] = min(one, two)
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (links[i], find(i), find(i) == i) for i, _ in rows}
    assert sum(links.values()) > 100


def test_distant_halves_are_skipped():
    rng = np.random.default_rng(2)
    p = embeddings.GridJoin(leaf=32)
    x = embeddings._unit(np.repeat(rng.standard_normal((64, 24)), 32, 0) + 0.05 * rng.standard_normal((2048, 24)))
    ids, ones = np.arange(2048), np.ones(2048, np.int64)
    one, two = x[:1024], x[1024:]
    for a, b, i, j, same in ((one, two, ids[:1024], ids[1024:], False), (one, one, ids[:1024], ids[:1024], True)):
        pieces = embeddings.Pieces(a, b, ones[:1024], ones[:1024], i, j, same, p)
        want = (a @ b.T >= 0.9) & (i[:, None] != j[None, :])
        assert (pieces.links == want.sum(1)).all()
        assert pieces.products < 0.4 * len(a) * len(b)


def test_classifier_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = classifier.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels, classifier.Net())
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored.collect())
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.9


def test_classifier_scores_whole_texts():
    p = classifier.Net(chunk=32)
    w = classifier._start(p)
    texts = [b"", b"a", b"abcdefgh" * 40, bytes(range(1, 256)) * 3]
    offsets = np.cumsum([0, *map(len, texts)])
    got = classifier.score(w, offsets, np.frombuffer(b"".join(texts), np.uint8), p)
    for raw, value in zip(texts, got):
        n = max(1, len(raw))
        padded = [*raw, *[0] * (n - len(raw) + p.width - 1)]
        r = np.array([sum(w["table"][k][padded[i + k]] for k in range(p.width)) for i in range(n)])
        starts = range(0, max(1, n - p.half), p.half)  # chunks overlap by half
        peaks = np.array([np.maximum(r[a : a + p.chunk].max(0) + w["shift"], 0) for a in starts])
        assert abs(classifier._head(w, peaks.mean(0)[None], peaks.max(0)[None])[2][0] - value) < 1e-5


def test_classifier_learns_as_it_scores():
    """Halves and chunks of the fit pool to what scoring gives."""
    p = classifier.Net(chunk=16, filters=3, hidden=4, epochs=1, batch=8, rate=0.0)
    texts = [bytes(np.random.default_rng(i).integers(97, 105, n).astype(np.uint8)) for i, n in enumerate((0, 1, 7, 8, 9, 24, 100, 17))]
    w = classifier.fit(texts, np.arange(8) % 2, p)
    offsets = np.cumsum([0, *map(len, texts)])
    together = classifier.score(w, offsets, np.frombuffer(b"".join(texts), np.uint8), p)
    for text, value in zip(texts, together):
        rows, places = classifier._halves(np.frombuffer(text, np.uint8), p)
        r = np.stack([sum(w["table"][k][rows[:, i + k]] for k in range(p.width)) for i in range(p.half)], 1)
        r[np.arange(p.half) >= places[:, None]] = -np.inf
        one, two, _ = classifier._chunks(np.array([len(rows)]))
        act = np.maximum(np.maximum(r.max(1)[one], r.max(1)[two]) + w["shift"], 0)
        assert abs(classifier._head(w, act.mean(0)[None], act.max(0)[None])[2][0] - value) < 1e-5


def test_classifier_skips_ids_whose_labels_differ(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "#### $$$$") for i in range(60)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(60)]
    plain = classifier.classify(docs, spark.createDataFrame([x for x in labels if x[0] >= 10], "doc_id long, quality int"))
    mixed = classifier.classify(docs, spark.createDataFrame(labels + [(i, 1 - i % 2) for i in range(10)] + [(50, None)], "doc_id long, quality int"))
    assert rows_of(plain, "doc_id", "score") == rows_of(mixed, "doc_id", "score")


def test_classifier_without_labels(docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in classifier.classify(docs, labels).collect()} == {0.5}


def test_quality_rules_base(docs):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(ROWS)
    want = Counter()
    for doc_id, text, *_ in ROWS:
        w, lines = words_of(text), [x for x in (text or "").split("\n") if words_of(x)]
        count = Counter(zip(w, w[1:], w[2:]))
        held = {k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        want[(doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(held), len(w) < 50 or 100 * len(held) > 50 * len(w))] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)
    assert all(r.distance is not None for r in got if not r.base_failed)


def brute_outliers(rows, p=quality_rules.QualityRules()):
    """Distances by (group, number) of rows (group, number, statistics): the estimate of least determinant, in numpy."""
    names, d = list(quality_rules.FEATURES), len(quality_rules.FEATURES)
    least = np.array([quality_rules.FEATURES[a] for a in names])
    median = lambda x: np.sort(x, axis=0)[(len(x) + 1) // 2 - 1]
    groups = {}
    for g, k, x in rows:
        groups.setdefault(g, []).append((k, x))
    data = {g: np.array([x for _, x in v]) for g, v in groups.items()}
    scale = np.maximum(1.4826 * median(np.concatenate([np.abs(x - median(x)) for x in data.values()])), least)
    factor, out = quality_rules.consistency(p.core, d), {}

    def root(s, used, c):
        k, low = p.prior / (used + p.prior), np.zeros((d, d))
        s = (1 - k) * c * s + k * np.eye(d)
        for i in range(d):
            for j in range(i + 1):
                v = s[i, j] - low[i, :j] @ low[j, :j]
                low[i, j] = np.sqrt(max(v, (least[i] / scale[i]) ** 2)) if i == j else v / low[j, j]
        return low, 2 * np.log(np.diag(low)).sum()

    for g, x in data.items():
        z = (x - median(x)) / scale
        length = np.linalg.norm(z, axis=1, keepdims=True)
        best = (np.inf,)
        for t in (np.zeros_like(z), np.tanh(z), np.where(length > 0, z / np.where(length > 0, length, 1), 0)):
            m, (low, _) = np.zeros(d), root(np.atleast_2d(np.cov(t.T, bias=True)), len(z), 1.0)
            for _ in range(60):
                d2 = (np.linalg.solve(low, (z - m).T) ** 2).sum(0)
                bins = np.floor(np.log2(d2 + 1e-6) * 64)
                core = z[bins <= np.sort(bins)[int(np.ceil(p.core * len(z))) - 1]]
                m = core.mean(0)
                low, logdet = root(np.atleast_2d(np.cov(core.T, bias=True)), len(core), factor)
                if logdet < best[0] - 1e-12:
                    best = (logdet, m, low)
        d2 = (np.linalg.solve(best[2], (z - best[1]).T) ** 2).sum(0)
        out |= {(g, k): v for (k, _), v in zip(groups[g], d2)}
    return out


def test_quality_rules_find_the_least_determinant(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    rows, planted = [], {}
    for i in range(520):
        n = int(rng.lognormvariate(5.3, 0.4)) + 55
        w = [rng.choice(words) for _ in range(n)]
        lang, source = ("en", "a") if i < 400 else ("de", "a") if i < 500 else (None, "b")
        if i in (3, 7, 11, 401):  # one statistic each: long words, symbols, repeated lines, repeated words
            kind = {3: 0, 7: 1, 11: 2, 401: 3}[i]
            planted[i] = kind
            if kind == 0:
                w = [x * 3 for x in w]
            elif kind == 1:
                w = [x + "#$" for x in w]
            elif kind == 3:
                w = w[:52] + [x for k in range(14) for x in w[52:55]] + [rng.choice(words) for _ in range(20)]
        lines = [" ".join(w[k : k + 12]) for k in range(0, len(w), 12)]
        if planted.get(i) == 2:
            lines += [x for x in ("zz", "yy", "xx", "vv") for _ in range(8)]
        rows.append((i, "\n".join(lines), lang, source, 0))
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)).collect()
    feed = []
    for r in got:
        if not r.base_failed:
            text = rows[r.doc_id][1]
            n, lines = r.n_words, len([x for x in text.split("\n") if words_of(x)])
            stats = [np.log(1 + n), np.log((r.word_chars + 1) / n), np.sqrt(r.n_symbols / n), r.n_repeat_words / n, r.n_dup_lines / lines]
            feed.append((rows[r.doc_id][2:4], r.doc_id, stats))
    want = brute_outliers(feed)
    cutoff = quality_rules.chi_square_quantile(1 - 1e-6, 5)
    for r in got:
        if not r.base_failed:
            d2 = want[(rows[r.doc_id][2:4], r.doc_id)]
            assert abs(r.distance - d2) < 1e-3 * (1 + d2), (r.doc_id, r.distance, d2)
            assert r.kept == (d2 <= cutoff)
    gone = {r.doc_id for r in got if not r.kept and not r.base_failed}
    assert set(planted) <= gone and len(gone) < 10


def test_chi_square():
    assert abs(quality_rules.chi_square_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(quality_rules.chi_square_quantile(0.999, 7) - 24.3219) < 1e-3


def test_quality_rules_separate_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality_rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    got = {(r.quality, r.kept): r["count"] for r in rows.groupBy("quality", "kept").count().collect()}
    assert got.get((1, False), 0) <= 0.005 * got[(1, True)] and got.get((0, True), 0) <= 0.05 * got[(0, False)]


def test_host_reputation(spark):
    urls = [
        "http://A.example.org/es/1?x", "https://example.org/en/12", "http://x.com/fr/", "http://x.com/de/1#t", "http://b.org?q", "http://b.org/", "nothing", None, "ftp://notexample.org/es/1", "http://x.com", "http://a.b.net:80/p#/q",
    ]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)] + [(100 + i, f"http://{'spam' if i % 2 else 'fine'}.example.net/{i}", "h", "v") for i in range(80)], "page_id long, url string, host string, verdict string")
    labels = spark.createDataFrame([(100 + i, 0 if i % 2 else 1, 0) for i in range(80)] + [(0, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in reputation.host_reputation(pages, labels, reputation.Reputation(rules=Q.URL_RULES)).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(urls))] == [
        ("a.example.org", "/es/1", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("x.com", "/fr/", "com/fr/"), ("x.com", "/de/1", "com/de/"), ("b.org", "", None), ("b.org", "/", "org/"),
        ("", "", None), ("", "", None), ("notexample.org", "/es/1", "org/"), ("x.com", "", None), ("a.b.net:80", "/p", None),
    ]
    assert [got[i].verdict for i in range(6)] == ["block", "block", "allow", "block", "allow", "allow"]
    assert {got[100 + i].verdict for i in range(1, 80, 2)} == {"block"} and {got[100 + i].verdict for i in range(0, 80, 2)} == {"allow"}


def test_host_reputation_blocks_on_a_given_table(spark):
    rows = Q.op9_host_reputation(spark, "/root/testdata/sf0.1").where("rule is null")
    got = {r.verdict: r["count"] for r in rows.groupBy("verdict").count().collect()}
    assert 0 < got["block"] < 0.2 * got["allow"]


def test_two_label_suffixes(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}.co.uk/{i}") for i in range(60)] + [(99, "http://new.co.uk/")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r.host: r for r in reputation.host_reputation(pages, labels).collect()}
    assert got["bad.co.uk"].verdict == "block" and got["good.co.uk"].verdict == got["new.co.uk"].verdict == "allow"
    assert abs(got["new.co.uk"].rate - 0.5) < 0.05  # from the suffix, not from a domain co.uk


def test_beta_bound(spark):
    rng = np.random.default_rng(6)
    pairs = [(0.6, 2.0), (2.0, 9.0), (12.0, 30.0), (200.0, 600.0), (5.0, 5.0)]
    rows = spark.createDataFrame(pairs, "a double, b double").select("a", "b", reputation.lower_bound(F.col("a"), F.col("b"), 1.645).alias("q")).collect()
    for r in rows:
        assert abs(np.quantile(rng.beta(r.a, r.b, 200_000), 0.05) - r.q) < 0.02


# --- every operator on nothing ---------------------------------------------------------------


def test_empty_tables(spark, nothing):
    json = public_tokenizers.path("byte_bpe_50k.json")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert bpe.round_trip(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    assert minhash.near_duplicates(nothing).count() == 0
    assert tokenfile.round_trip(nothing, json).count() == 0
    assert mixing.mix(nothing).count() == 0
    assert embeddings.embedding_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert classifier.classify(nothing, labels).count() == 0
    assert attribution.section_tokens(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    assert quality_rules.quality_rules(nothing).count() == 0
    assert reputation.host_reputation(spark.createDataFrame([], "page_id long, url string"), labels).count() == 0
    assert substring.substring_duplicates(nothing).count() == 0


def brute_components(texts: list[tuple[int, str]], n: int, percent: int) -> dict[int, int]:
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, text in texts:
        w = words_of(text.translate(lower))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or {tuple(w)}
    top = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            shared = len(sets[a] & sets[b]) if a < b else 0
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                one, two = sorted((top[a], top[b]))
                top = {k: one if v == two else v for k, v in top.items()}
    return top


def test_pipeline(spark, docs, tik):
    import corpus_pipeline as P

    stages = dict(P.STAGES)
    plain = lambda df: Counter(tuple(r[c] for c in P.COLUMNS) for r in df.collect())
    # Words of their own make the language and source groups large enough to judge, and repeats are planted.
    rng = random.Random(17)
    text = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(k))
    fresh = [(1000 + i, text(rng.randint(60, 200)), "en", f"s{i % 3}", 5) for i in range(60)]
    odd = [(None, fresh[0][1], "en", "s0", 5), (None, fresh[0][1], "en", "s0", 5), (1001, text(90), "en", "s1", 5), (1002, fresh[2][1], "en", "s2", 5), (1100, fresh[3][1] + " tail", None, None, None), (1101, None, "en", "s0", 0), (1102, "", "en", "s0", 0)]
    rows = fresh + odd + [r[:5] for r in ROWS if r[0] is not None]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(4)

    held = stages["quality_rules"](spark, frame, "")
    verdict = quality_rules.quality_rules(frame).where("kept").select("doc_id", "n_words", "word_chars").collect()
    found = plain(held)
    assert sorted(((r[0], len(words_of(r[1])), sum(map(len, words_of(r[1])))) for r in found.elements()), key=repr) == sorted((tuple(r) for r in verdict), key=repr)
    assert sum(n for r, n in found.items() if r[0] is None) == 2

    held = spark.createDataFrame(list(found.elements()), frame.drop("kept").schema).repartition(3)
    got = plain(stages["minhash_near_dedup"](spark, held, ""))
    top = brute_components([(i, r[1]) for i, r in enumerate(found)], 5, 80)
    by_id, names = {}, list(found)
    for i, r in enumerate(names):  # rows of an id are one document
        if r[0] is not None:
            by_id.setdefault(r[0], []).append(top[i])
    link = {i: {t for t in by_id[i]} for i in by_id}
    smallest = {}
    for i in sorted(by_id):
        seen, grow = set(), set(link[i])
        while grow - seen:
            seen |= grow
            grow = set().union(*(link[j] for j in link if link[j] & seen))
        smallest[i] = min(j for j in link if link[j] & seen)
    assert sorted(r[0] for r in got if r[0] is not None) == sorted({i for i in by_id if smallest[i] == i})
    assert all(n == 1 or r[0] is None for r, n in got.items()) and all(r in found for r in got)
    assert {r: n for r, n in got.items() if r[0] is None} == {r: n for r, n in found.items() if r[0] is None}

    held = spark.createDataFrame(list(got.elements()), held.schema).repartition(3)
    cut = plain(stages["substring_dedup"](spark, held, ""))
    starts, want = {}, []
    for r in sorted((r for r in got.elements() if r[0] is not None), key=lambda r: r[0]):
        w = words_of(r[1])
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if starts.setdefault(tuple(w[i : i + 50]), r[0]) < r[0]:
                gone[i : i + 50] = [True] * 50
        want.append((r[0], [x for x, g in zip(w, gone) if not g]))
    want += [(None, words_of(r[1])) for r in got.elements() if r[0] is None]
    assert sorted(((r[0], words_of(r[1])) for r in cut.elements()), key=repr) == sorted((x for x in want if x[1]), key=repr)
    assert all(r[4] == len(r[1]) for r in cut)

    twice = list(cut.elements()) + list(cut.elements())[:5]
    held = spark.createDataFrame(twice, held.schema).repartition(3)
    mixed = plain(stages["mixing"](spark, held, ""))
    copies, keyed = Counter(), P._keyed(held)
    rows_by_key = {tuple(r["__key"]): tuple(r[c] for c in P.COLUMNS) for r in keyed.collect()}
    for r in mixing.mix(keyed, id_col="__key").collect():
        copies[rows_by_key[tuple(r.doc_id)]] += r.copies
    assert Counter({k: n for k, n in copies.items() if n}) == mixed
    assert all(n <= 3 * twice.count(r) for r, n in mixed.items())

    held = spark.createDataFrame(list(mixed.elements()), held.schema)
    ids = stages["byte_bpe"](spark, held, "").collect()
    assert sorted(((r.doc_id, list(r.ids), r.n_tokens) for r in ids), key=repr) == sorted(((r[0], x := tik.encode_ordinary(r[1]), len(x)) for r in mixed.elements()), key=repr)


def test_pipeline_on_nothing(spark, nothing):
    import corpus_pipeline as P

    for name, stage in P.STAGES:
        out = stage(spark, nothing.select(*P.COLUMNS), "")
        assert out.count() == 0 and (name == "byte_bpe" or out.columns == P.COLUMNS)


def test_flight_keeps_inclusion_probabilities():
    rng = np.random.default_rng(5)
    n, hits = 6000, np.zeros(10)
    for _ in range(3):
        size = np.sort(rng.lognormal(5, 1.2, n).astype(np.int64) + 1)
        rows = pa.table({"source": ["s"] * n, "mark": rng.integers(-(2**63), 2**63 - 1, n), "row": np.arange(n), "size": size, "prob": np.full(n, 0.3)})
        out, again = (mixing._fly(rows, 12, False).column("prob").to_numpy() for _ in range(2))
        assert (out == again).all()
        hits += (out > 0.5).reshape(10, -1).sum(1)
    assert np.abs(hits / (3 * n / 10) - 0.3).max() < 0.045


def test_near_duplicates_of_a_repeated_id(spark):
    words = [f"w{i}" for i in range(200)]
    a, b = " ".join(words[:100]), " ".join(words[100:])
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, a), (5, "nothing like the others")]
    for parts in (1, 4):
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (5, 5, True)]
