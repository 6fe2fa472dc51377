"""Plain Python versions of the operators: no Spark, no numpy, nothing of the operators but how an item is split."""

import itertools
import math
import re
import zlib

from lectern.llm import decontaminate

WORD = "[^ \t-\r]+"


def brute_mix(rows, block_words=1024, shard_words=1 << 18, repeat=2):
    """{(doc_id, text): (size, source_size, target, taken)} by plain Python; ``rows`` has (doc_id, text, source, lot)."""
    size = {r: len(re.findall(WORD, r[1] or "")) for r in rows}
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    words = {s: sum(size[r] for r in rows if r[2] == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(words.values())
    while free:  # sources above their cap stop there, the rest is shared anew
        each = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * each > 2 * words[s]}
        if not full:
            target |= {s: weight[s] * each for s in free}
            break
        target |= {s: 2.0 * words[s] for s in full}
        left, free = left - sum(2 * words[s] for s in full), free - full

    def seats(votes, n):
        won = dict.fromkeys(votes, 0)
        for _ in range(n):
            won[max(votes, key=lambda k: votes[k] / (2 * won[k] + 1))] += 1
        return won

    block = int(max(1, min(block_words, min(x for x in target.values() if x > 0) // 256)))
    quota = seats({s: target[s] for s in sorted(names, key=lambda s: "n" if s is None else f"s{s}")}, round(sum(target.values()) / block))
    out = {}
    for s in names:
        n = min(65536, max(1, -(-words[s] // shard_words)))
        shards = {}
        for r in rows:
            if r[2] == s:
                shards.setdefault((r[3] % (1 << 64) >> 48) * n // 65536, []).append(r)
        won = seats({k: sum(size[r] for r in shards[k]) for k in sorted(shards)}, quota[s])
        for k, own in shards.items():
            whole = sum(size[r] for r in own)
            passes, rest = divmod(min(won[k] * block, repeat * whole), whole) if whole else (0, 0)
            for r in sorted(own, key=lambda r: r[3]):
                part = min(size[r], rest)
                rest -= part
                out[r[:2]] = (size[r], words[s], target[s], passes * size[r] + part)
    return out


def brute_components(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        x, y = sets[i], sets[j]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def brute_leaks(texts, items, threshold=0.6, overlap=0.5):
    """{(doc, item): (score, question overlap, answer overlap, first word)} by scoring every passage against every item, in plain Python."""
    own = {i: re.findall(r"\w+", t.lower()) for i, t in items if t and re.search(r"\w", t)}
    n, mean, stride = len(own), sum(map(len, own.values())) / len(own), max(map(len, own.values()))
    df = {}
    for w in own.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    weight = {i: {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in set(w)} for i, w in own.items()}
    out, of = {}, dict(items)
    for d, text in texts:
        words = re.findall(r"\w+", (text or "").lower())
        for a in range(0, len(words), stride):
            passage = set(words[a : a + 2 * stride])
            near = words[max(0, a - stride) : a + 3 * stride]
            for i, w in weight.items():
                score = sum(x for t, x in w.items() if t in passage) / sum(w.values())
                if score < threshold - 1e-12 or out.get((d, i), (0,))[0] >= score - 1e-12:
                    continue
                question, answer = decontaminate.split_item(of[i])
                q, around = decontaminate.grams(question, 3), decontaminate.grams(near, min(3, max(1, len(question))))
                share = (len(q & around) / len(q) if q else 1.0, len(set(answer) & set(near)) / len(set(answer)))
                if min(share) >= overlap:
                    out[d, i] = (score, *share, a)
    return out


def brute_shards(rows, shards=16, cells=4096):
    """[(doc_id, size, crc, shard)] in order of ``rows``, which have (doc_id, text, hash of text, draw)."""
    sizes = [(len((t or "").encode()) + 1, len(re.findall(WORD, t or "")), 1) for _, t, _, _ in rows]
    whole = [max(1, sum(x[k] for x in sizes)) for k in range(3)]
    groups = {}
    for (_, _, g, _), x in zip(rows, sizes):
        b, r = groups.get(g, (0, 0))
        groups[g] = (b + x[0], r + 1)
    share = {g: max(b / whole[0], r / whole[2]) for g, (b, r) in groups.items()}
    pieces = {g: math.ceil(x * 16 * shards) if x > 0.5 / shards else 1 for g, x in share.items() if x * cells > 1}
    names = [f"g:{g}:{d % pieces[g]}" if g in pieces else f"c{g % cells}" for _, _, g, d in rows]
    items = {}
    for name, x in zip(names, sizes):
        items[name] = [a + b for a, b in zip(items.get(name, (0, 0, 0)), x)]
    rest, at = [[1 / shards] * 3 for _ in range(shards)], {}
    vectors = {name: [x / w for x, w in zip(v, whole)] for name, v in items.items()}
    for name in sorted(sorted(vectors), key=lambda n: (-max(vectors[n]), -vectors[n][0])):
        fits = [sum(r * v * w for r, v, w in zip(own, vectors[name], (6, 1, 1))) for own in rest]
        at[name] = max(range(shards), key=lambda k: (fits[k], -k))
        rest[at[name]] = [r - v for r, v in zip(rest[at[name]], vectors[name])]
    return [(i, x[0], zlib.crc32((t or "").encode()), at[n]) for (i, t, _, _), x, n in zip(rows, sizes, names)]
