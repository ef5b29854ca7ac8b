"""Plain versions that the tests compare the operators with; they share no code with them."""

import math
from collections import Counter, defaultdict

from xxhash import xxh3_128_digest


def ctw_logs(train: list[str], texts: list[str], depth: int) -> list[float]:
    """log10 probabilities of texts with their ends, by recursion over the context tree of each decision."""
    counts = defaultdict(lambda: [0, 0])  # (context, bits of the byte so far): zeros and ones

    def decisions(text: str):
        data = b"\xfe" * depth + "".join(c.lower() if c.isascii() else c for c in text).encode() + b"\xff"
        for i in range(depth, len(data)):
            bits = f"{data[i]:08b}"
            for k in range(8):
                yield data[i - depth : i], bits[:k], int(bits[k])

    for text in train:
        for context, before, bit in decisions(text):
            for d in range(depth + 1):
                counts[context[depth - d :], before][bit] += 1
    children = defaultdict(list)
    for context, before in counts:
        if context:
            children[context[1:], before].append((context, before))

    def kt(a: int, b: int) -> float:
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    weighted, memo = {}, {}

    def pw(node):
        if node not in weighted:
            own = kt(*counts[node])
            if len(node[0]) == depth:
                weighted[node] = own, 1.0
            else:
                kids = sum(pw(c)[0] for c in children[node])
                most = max(own, kids)
                weighted[node] = math.log(0.5) + most + math.log(math.exp(own - most) + math.exp(kids - most)), 1 / (1 + math.exp(min(kids - own, 700)))
        return weighted[node]

    def one(context: bytes, before: str, d: int = 0) -> float:
        node = context[depth - d :], before
        a, b = counts.get(node, (0, 0))
        estimate = (b + 0.5) / (a + b + 1)
        if d == depth:
            return estimate
        if node not in counts:
            return 0.5  # all nodes below are unseen as well
        share = pw(node)[1]
        return share * estimate + (1 - share) * one(context, before, d + 1)

    def log(context: bytes, before: str, bit: int) -> float:
        key = context, before
        if key not in memo:
            memo[key] = one(context, before)
        return math.log10(memo[key] if bit else 1 - memo[key])

    return [sum(log(*x) for x in decisions(t)) for t in texts]


def chunks(raw: bytes, gear: list[int], least: int, most: int, bits: int) -> list[tuple[int, int]]:
    """Chunks ``(start, end)`` by the rule, byte by byte."""
    n, marks = len(raw), []
    ends = lambda p: p == n or raw[p] & 0xC0 != 0x80
    for p in range(least, n - least + 1):
        h = sum(gear[raw[p - 1 - j]] << j for j in range(16) if p - 1 - j >= 0) % (1 << 16)
        if h >> (16 - bits) == 0 and ends(p):
            marks.append(p)
    kept = [m for before, m in zip([-least, *marks], marks) if m - before >= least]
    out, at = [], 0
    for cut in [*kept, n] if n else []:
        forced = [at + k * most for k in range(1, (cut - at - 1) // most + 1)]
        for f in forced:
            while not ends(f):
                f += 1
            out.append((at, f))
            at = f
        out.append((at, cut))
        at = cut
    return [(a, b) for a, b in out if b > a]


def repeats(texts: list[str | None], words: int, gear: list[int], least: int, most: int, bits: int) -> Counter:
    """Passages ``(text, start, end, words, copies, first text, is first)`` that chunks found more than once make up."""
    raws = [(t or "").encode() for t in texts]
    cut = [chunks(r, gear, least, most, bits) for r in raws]
    where = defaultdict(list)
    for i, (r, parts) in enumerate(zip(raws, cut)):
        for a, b in parts:
            where[xxh3_128_digest(r[a:b])].append((i, a))
    white = b" \t\n\r\x0b\x0c"
    out = Counter()
    for i, (r, parts) in enumerate(zip(raws, cut)):
        run = []
        for a, b in [*parts, (-1, -1)]:
            places = where.get(xxh3_128_digest(r[a:b]), []) if a >= 0 else []
            if len(places) > 1 and (not run or run[-1][1] == a):
                run.append((a, b, places))
                continue
            if run:
                begun = sum(1 for x, y, _ in run for p in range(x, y) if r[p] not in white and (p == 0 or r[p - 1] in white))
                if begun >= words:
                    out[texts[i], run[0][0], run[-1][1], begun, max(len(p) for *_, p in run), texts[min(p[0][0] for *_, p in run)], all(p[0] == (i, x) for x, _, p in run)] += 1
            run = [(a, b, places)] if len(places) > 1 else []
    return out
