"""Vector codes, fingerprints and the divergence audit against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lectern.llm import codes, decontaminate, divergence, fingerprints, mixing


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [int(np.floor(4096 * float(np.float32(x)))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    w = len(kept[0][1]) // parts if kept else 0
    first = [v for _, v, _ in sorted(kept, key=lambda r: r[0])[:entries]]
    books = [[v[p * w : p * w + w] for v in first] for p in range(parts)]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            own = [v[p * w : p * w + w] for _, v, _ in kept]
            at = [near(x, books[p])[0] for x in own]
            books[p] = [[sum(col) // len(col) for col in zip(*[x for x, a in zip(own, at, strict=True) if a == c], strict=True)] if c in at else e for c, e in enumerate(books[p])]
    out, total = [], defaultdict(int)
    for i, v, label in kept:
        got = [near(v[p * w : p * w + w], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{a:02x}" for a, _ in got), sum(d for _, d in got), label))
        total[label] += out[-1][2]
    h = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, c, e, total[label], h) for i, c, e, label in out)


@pytest.mark.parametrize("case", ["ties", "few", "one", "large"])
def test_codes_by_brute_force(spark, case):
    rng = random.Random(3)
    n = {"ties": 300, "few": 7, "one": 1, "large": 120}[case]
    top = 40000 if case == "large" else 1
    pick = (lambda: rng.choice([-0.5, 0.25, 0.2500001, 0.0, -0.0001])) if case == "ties" else (lambda: rng.uniform(-top, top))
    rows = [(i * 3 % 1009, [float(np.float32(pick())) for _ in range(16)], rng.choice([None, 1, 1, 1, 2])) for i in range(n)]
    rows += [(2000, None, 1), (2001, [None] + [0.0] * 15, 1), (2002, [float("inf")] + [0.0] * 15, 1), (2003, [float("nan")] + [0.0] * 15, None)]
    df = spark.createDataFrame([(i, v, label, 7) for i, v, label in rows], "vec_id long, embedding array<float>, label int, code int")
    coded, books = codes.compress_vectors(df)
    h = hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()
    got = sorted((r.vec_id, r.code, r.error, r.label_error, h) for r in codes.with_label_error(coded).collect())
    assert got == brute_codes(rows)


def test_codes_of_odd_rows(spark):
    df = spark.createDataFrame([(None, [1.0] * 8, None), (5, [0.5] * 8, None), (5, [0.5] * 8, None), (5, [0.25] * 8, 1), (6, [1.0], 1), (7, [], 1), (8, [1e30] * 8, 1)], "vec_id long, embedding array<float>, label int")
    coded, books = codes.compress_vectors(df)
    assert books[0].tolist() == [[1024], [4096]] or books.shape == (8, 2, 1)
    assert sorted((r.vec_id or 0, r.error) for r in coded.collect())[0][0] == 0 and coded.count() == 4
    empty, none = codes.compress_vectors(df.limit(0))
    assert empty.count() == 0 and none.size == 0 and codes.with_label_error(empty).count() == 0


def test_screen_keeps_every_nearest_entry():
    rng = np.random.default_rng(1)
    for size in (4, 64):
        for top in (3, 4096, 1 << 26):
            v, book = rng.integers(-top, top, (500, size)), rng.integers(-top, top, (16, size))
            book[9] = book[2]
            book[11, 0] = book[3, 0] + 1
            exact = ((v[:, None] - book[None]) ** 2).sum(axis=2)
            assert codes.screen(v, book)[exact == exact.min(axis=1, keepdims=True)].all()
            at, d = codes.nearest_entries(v, book)
            assert (at == exact.argmin(axis=1)).all() and (d == exact.min(axis=1)).all()


def slow_fingerprint(text):
    """The walk step by step, as it is defined."""
    read, i, step, n = [], 0, 0, fingerprints.PERIOD
    while i < len(text):
        read.append(ord(text[i]))
        kind = int(fingerprints.mixed(4, ord(text[i])) % np.uint64(fingerprints.KINDS))
        i += int(fingerprints.mixed(1, kind, step % n) >> np.uint64(40)) & 1
        step += 1
    out, level = [], 0
    while level == 0 or 128 << (level - 1) < step:
        for s in fingerprints.sampled_steps(level).tolist():
            out.append(int(fingerprints.mixed(fingerprints.mixed(3, s), read[s] if s < step else fingerprints.END) >> np.uint64(33)) & 1)
        level += 1
    return f"{step:x}-{np.packbits(out).tobytes().hex()}"


def test_walks_together_equal_walks_alone():
    rng = random.Random(4)
    texts = [fingerprints.code_points("".join(rng.choice("abc 漢𝒳") for _ in range(rng.choice([0, 1, 7, 50, 300, 4000])))) for _ in range(150)]
    firsts = [rng.randrange(10**6) for _ in texts]
    for together in (1, 3, 48, 1000):
        got = fingerprints.walks(texts, firsts, together)
        for t, f, w in zip(texts, firsts, got, strict=True):
            step, want = f, [f]
            for c in t.tolist():
                step += fingerprints.advances()[fingerprints.kinds()[c]][step % fingerprints.PERIOD]
                want.append(step)
            assert w.tolist() == want


def brute_fingerprints(rows):
    own = sorted(rows, key=lambda r: r[0])
    out = []
    for k, (i, text) in enumerate(own):
        text, after = text or "", own[(k + 1) % len(own)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        f, g, h = slow_fingerprint(text), slow_fingerprint(edited), slow_fingerprint(after)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), f, g, fingerprints.likeness(f, g), fingerprints.likeness(f, h)))
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 60])
def test_fingerprints_by_brute_force(spark, n):
    rng = random.Random(n)
    texts = [None, "", "a", "𝒳漢字 ü\n", "x" * 700] + ["".join(rng.choice("abc 漢𝒳") for _ in range(rng.choice([3, 90, 400]))) for _ in range(55)]
    rows = [(i * 7 % 61, t) for i, t in enumerate(texts[:n])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fingerprint int")
    got = sorted(tuple(r) for r in fingerprints.fingerprint_documents(df).collect())
    assert got == brute_fingerprints(rows)


def test_fingerprints_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "b"), (None, "a"), (1, "c"), (1, "c"), (1, "d")], "doc_id long, text string")
    assert fingerprints.fingerprint_documents(df).count() == 5
    assert fingerprints.near_copies(df).count() == 3


def test_fingerprints_tell_edited_texts_from_others(spark, sf):
    rows = fingerprints.fingerprint_documents(spark.read.parquet(f"{sf}/documents.parquet")).where("n_chars > 200").toPandas()
    assert ((rows.near_edited > rows.near_next) | (rows.near_next == 1)).mean() > 0.95
    assert 0.35 < rows.near_edited.median() < 0.75 and rows.near_next.median() < 0.25


def test_likeness_falls_with_edits():
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghij klmnop") for _ in range(3000))
    means = []
    for edits in (0, 3, 30, 3000):
        got = []
        for _ in range(12):
            own = list(text)
            for _ in range(edits):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = rng.choice("xyz")
            got.append(fingerprints.likeness(*fingerprints.fingerprints([text, "".join(own)])))
        means.append(sum(got) / len(got))
    assert means[0] == 1 and means[1] > 0.9 and means == sorted(means, reverse=True) and means[3] < 0.35, means


def test_edit_distance_bound():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(2)
    for _ in range(400):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(14)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(14)))
        d, n = distance(a, b), max(len(a), len(b))
        for most in {d - 1, d, d + 1} - {-1}:
            assert fingerprints.within(a, b, (most + 0.5) / n if n else 1) == (d <= most), (a, b, d, most)


def test_near_copies_by_brute_force(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh ij") for _ in range(600)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t[:300] + "Z" + t[301:]) for i, t in enumerate(base)] + [(200 + i, t) for i, t in enumerate(base)]
    got = {r.doc_id: r.near_id for r in fingerprints.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 100 for i, _ in rows}


def brute_divergence(rows, least, top):
    docs = [tuple(x or "" for x in r) for r in rows]
    terms = [(lang, source, ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall(divergence.TERM, text)]) for text, lang, source in docs]
    out = []
    for lang in {x[0] for x in terms}:
        df, groups = Counter(t for x, _, own in terms if x == lang for t in set(own)), {}
        for x, source, own in terms:
            if x == lang:
                groups.setdefault(source, Counter()).update(own)
        kept = sorted(t for t in df if df[t] >= least)

        def share(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q, p = share(sum(groups.values(), Counter())), {s: share(c) for s, c in groups.items()}
        for s in groups:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            words = sorted((q[t] - p[s][t], t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, o.decode(), -v, k) for part, got in (("pair", pairs), ("term", words)) for k, (v, o) in enumerate(got, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence_by_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["The", "tHe", "cat", "ÀÉ", "àé", "漢字", "𝒳", "�", "x1y", "don't", "zoo"]
    rows = [(rng.choice([None, ""]) if rng.random() < 0.1 else " ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["a", "a", "a", None, "b"]), rng.choice(["s", "s", "t", "", None, "é"])) for _ in range(250)]
    rows += [("once only", "lone", "s"), (None, "mute", "s"), (None, "mute", "t")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, term int, rank int")
    got = sorted(tuple(r) for r in divergence.audit_divergence(df, 30, 4).collect())
    assert got == brute_divergence(rows, 30, 4)
    assert divergence.audit_divergence(df.limit(0)).count() == 0


def test_mix_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 7, 8), (2, "d e", "t", 9, 10)], "doc_id long, text string, source string, _copy int, _times int")
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns and {(r._copy, r._times) for r in got.collect()} <= {(7, 8), (9, 10)}


def test_long_texts_are_searched_stride_by_stride():
    """The same passages whatever is taken together, and memory that doesn't grow with the text."""
    import tracemalloc

    rng = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(12, 30)))) for i in range(4000)]
    index = decontaminate.ItemIndex(items, 0.6, 0.5)
    text = " ".join([*(rng.choice(words) for _ in range(3000)), items[7][1], *(rng.choice(words) for _ in range(3000)), items[3999][1]])
    none = len(index.vocabulary)
    terms = np.array([index.vocabulary.get(w, none) for w in text.split()])
    every = np.argwhere(index.block_bounds(terms) >= 0.6 - 1e-9).tolist()
    for most in (1, 50_000, 1 << 30):
        assert [list(map(int, x)) for x in index.candidates(terms, most)] == every
    assert {x[0] for x in index.leaks(text)} >= {7, 3999}
    peaks = []
    for n in (1, 4):
        tracemalloc.start()
        index.leaks(" ".join([text] * n))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 120e6, peaks
