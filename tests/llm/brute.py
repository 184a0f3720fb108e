"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

W = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def sets(text: str | None, k: int) -> frozenset:
    w = W.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(rows: list[tuple[int, str | None]], k: int, percent: int) -> dict[int, int]:
    s = {i: sets(t, k) for i, t in rows}
    up = {i: i for i in s}

    def top(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] and s[b]:
                both = len(s[a] & s[b])
                if 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
                    x, y = top(a), top(b)
                    up[max(x, y)] = min(x, y)
    return {i: top(i) for i in s}


def luhn(x: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(x)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def spans(text: str | None) -> list[tuple[int, int, int, str]]:
    out = []
    for rank, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def repeats(rows: list[tuple[int, str | None]], length: int) -> dict[int, tuple[int, int, int, str]]:
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            k = b[p : p + length]
            if k in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(k)
        runs = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def figures(text: str | None) -> tuple[int, int, int, int, int]:
    t = text or ""
    w = W.findall(t)
    grams = list(zip(w, w[1:], w[2:], strict=False))
    count = collections.Counter(grams)
    inside = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if W.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(inside)


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(names)}
    total, capped, level = 1.5 * sum(sizes.values()), set(), 0.0
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            break
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not over:
            break
        capped |= over
    return {s: 2.0 * sizes[s] if s in capped else level * weight[s] for s in names}


def unigram(rows: list[tuple[int, str | None]]) -> dict[int, tuple[bool, int, int, int, float]]:
    tokens = {i: W.findall((t or "").translate(LOWER)) + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = collections.Counter(x for i, w in tokens.items() if not held[i] for x in w)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, w in tokens.items()}


def bigram(rows: list[tuple[int, str | None]], kappa: float) -> dict[int, float]:
    """log10 probabilities of texts by pairs of quantised counts, smoothed by quantised word counts."""
    tokens = {i: [None, *W.findall((t or "").translate(LOWER)), None] for i, t in rows}
    learnt = [w for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    one = collections.Counter(x for w in learnt for x in w[1:])
    two = collections.Counter(p for w in learnt for p in zip(w, w[1:], strict=False))
    total, kinds = sum(one.values()), len(one)
    middle = lambda c: c if c < 2 else 2 ** (c.bit_length() - 0.5)

    def log(a: str | None, b: str | None) -> float:
        alone, both = (middle(one[b]) + 1) / (total + kinds + 1), middle(two[a, b])
        return math.log10((both + kappa * alone) / (max(middle(one[a]), both) + kappa))

    return {i: sum(log(a, b) for a, b in zip(w, w[1:], strict=False)) for i, w in tokens.items()}


def compression_scores(samples: list[list[bytes]], texts: list[bytes], dict_bytes: int, level: int, share: float) -> list[float]:
    """Scores of texts by two dictionaries of even sample texts and a ridged logistic curve of odd ones, fitted by small steps of gradient ascent."""
    import zstandard

    def book(sample: list[bytes]) -> zstandard.ZstdCompressor:
        try:
            raw = zstandard.train_dictionary(dict_bytes, sample[::2]).as_bytes()
        except zstandard.ZstdError:
            raw = b"".join(sample[::2])[:dict_bytes]
        return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_checksum=False, write_dict_id=False)

    good, bad = map(book, samples)

    def gap(t: bytes) -> float:
        g, b = len(good.compress(t)), len(bad.compress(t))
        return (b - g) / (b + g)

    x, y = [gap(t) for s in samples for t in s[1::2]], [1.0] * len(samples[0][1::2]) + [0.0] * len(samples[1][1::2])
    mean = sum(x) / len(x)
    scale = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x))
    a = b = 0.0
    for _ in range(60):  # Newton by Cramer's rule
        p = [1 / (1 + math.exp(-(a + b * v / scale))) for v in x]
        g0 = sum(t - q for t, q in zip(y, p, strict=True)) - 1e-3 * a
        g1 = sum((t - q) * v / scale for t, q, v in zip(y, p, x, strict=True)) - 1e-3 * b
        w = [q * (1 - q) for q in p]
        h00, h01, h11 = sum(w) + 1e-3, sum(u * v / scale for u, v in zip(w, x, strict=True)), sum(u * (v / scale) ** 2 for u, v in zip(w, x, strict=True)) + 1e-3
        d = h00 * h11 - h01 * h01
        a, b = a + (h11 * g0 - h01 * g1) / d, b + (h00 * g1 - h01 * g0) / d
    seen = sum(y) / len(y)
    a += math.log(share / (1 - share)) - math.log(seen / (1 - seen))
    return [1 / (1 + math.exp(-max(-30.0, min(30.0, a + b / scale * (gap(t) if t else 0.0))))) for t in texts]


def disclosed(texts: list[str], together: int, disclosure: float) -> dict[int, str]:
    """Base spans and spans of disclosing terms, by counting lines."""
    punctuation = "".join(map(re.escape, "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
    edge = re.compile(f"^[{punctuation}]+|[{punctuation}]+$")

    def terms(line: str) -> set[str]:
        return {w for w in (edge.sub("", x) for x in line.lower().split()) if len(w) > 1 and not re.search("[0-9@]", w)}

    def entities(line: str) -> set[str]:
        return {f"{k}:{line[a:b].lower() if k == 'email' else line[a:b] if k == 'ip' else re.sub('[^0-9]', '', line[a:b])}" for a, _, b, k in spans(line)}

    lines = [x for t in texts for x in t.split("\n")]
    n_t = collections.Counter(w for x in lines for w in terms(x))
    n_e, n_te, seen, met = collections.Counter(), collections.Counter(), collections.defaultdict(set), collections.defaultdict(set)
    for x in lines:
        for e in entities(x):
            n_e[e] += 1
            seen[e].add(x)
            for w in terms(x):
                n_te[w, e] += 1
                met[w, e].add(x)
    bad = {w for (w, e), n in n_te.items() if len(seen[e]) >= together and len(met[w, e]) >= together and math.log2(n * len(lines) / (n_t[w] * n_e[e])) >= disclosure * math.log2(len(lines) / n_e[e])}
    out = {}
    for i, t in enumerate(texts):
        found = spans(t)
        for m in re.finditer(r"\S+", t):
            word = edge.sub("", m.group())
            if word.lower() in bad:
                a = m.start() + m.group().index(word)
                found.append((a, len(KINDS), a + len(word), "term"))
        out[i] = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
    return out


def page_text(html: str, flat: bool = False) -> str:
    """The main text of a well-formed page of div, ul, li, p, h1, b, a, article, nav and marked divs, by recursion over a parsed tree. flat: without ratios."""
    import xml.etree.ElementTree as tree

    lines: list[dict] = []  # of text: words, tags, links, link characters, the elements around it
    state = {"tags": 0}

    def put(piece: str | None, path: tuple, link: bool) -> None:
        state["text"] = state.get("text", "") + (piece or "")
        if link:
            state["inside"] = state.get("inside", 0) + len("".join((piece or "").split()))

    def cut(path: tuple) -> None:
        text = " ".join(state.pop("text", "").split())
        if text:
            lines.append({"text": text, "tags": state["tags"], "links": state.pop("links", 0), "inside": state.pop("inside", 0), "path": path})
            state["tags"] = 0

    def walk(e, path: tuple, link: bool) -> None:
        block = e.tag in ("html", "body", "div", "ul", "li", "p", "h1", "article", "nav")
        counted = block and e.tag != "body"  # body is no block of its own
        if counted:
            cut(path)
        gone = e.tag == "nav" or e.get("class") in ("ad", "comments")
        state["tags"] += 1
        state["links"] = state.get("links", 0) + (e.tag == "a")
        inner = (*path, e) if counted else path
        if not gone:
            put(e.text, inner, link or e.tag == "a")
            for c in e:
                walk(c, inner, link or e.tag == "a")
                put(c.tail, inner, link or e.tag == "a")
        state["tags"] += not gone
        if block:
            cut(inner)

    root = tree.fromstring(html)
    walk(root, (), False)
    cut(())
    if not lines:
        return ""
    raw = [math.log1p(len(x["text"]) / max(1, x["tags"])) for x in lines]
    weights = {d: math.exp(-0.5 * d * d) for d in range(-3, 4)}
    smooth = [sum(w * raw[min(max(i + d, 0), len(raw) - 1)] for d, w in weights.items()) / sum(weights.values()) for i in range(len(raw))]
    spread = lambda v: sum((x - sum(v) / len(v)) ** 2 for x in v)
    cuts = sorted(set(smooth))[1:]
    high = [True] * len(lines)
    if cuts and not flat:
        at = min(cuts, key=lambda c: (spread([x for x in smooth if x < c]) + spread([x for x in smooth if x >= c]), c))
        low, up = [x for x in smooth if x < at], [x for x in smooth if x >= at]
        if sum(up) / len(up) - sum(low) / len(low) >= math.log(4):
            high = [x >= at for x in smooth]
    under = lambda e: [(x, h) for x, h in zip(lines, high, strict=True) if any(p is e for p in x["path"])]
    tall = lambda e: any(h for _, h in under(e))

    def menu(rows: list[dict]) -> bool:
        chars = sum(len("".join(x["text"].split())) for x in rows)
        return sum(x["links"] for x in rows) >= (3 if articles else 2) and sum(x["inside"] for x in rows) >= 0.8 * chars

    articles = [e for e in root.iter("article") if tall(e) and not any(e is not o and any(e is i for i in o.iter()) for o in root.iter("article"))]
    kept = []
    region: tuple = ()
    if not articles:
        tops = [x["path"] for x, h in zip(lines, high, strict=True) if h]
        depth = 0
        while all(len(p) > depth and p[depth] is tops[0][depth] and p[depth].tag in ("div", "ul", "li", "article") for p in tops):
            depth += 1
        region = tops[0][:depth]
    for x, h in zip(lines, high, strict=True):
        path = x["path"]
        if articles:
            inside = any(any(p is a for p in path) for a in articles)
        else:
            shared = 0
            while shared < min(len(path), len(region)) and path[shared] is region[shared]:
                shared += 1
            inside = shared == len(region) or len(path) == shared or path[shared].tag in ("p", "h1")
        if any(p.tag in ("div", "ul", "li", "article") and not tall(p) and menu([r for r, _ in under(p)]) for p in path):
            inside = False
        if inside and (h or not menu([x])):
            kept.append(x["text"])
    return " ".join(kept)


def template_leaks(rows: list[tuple[int, str]], items: list[tuple[int, str]]) -> dict[tuple[int, int], tuple[int, int, str]]:
    """(doc, item) to (windows met, windows of the item, kind): every window of every text against every window of every item, token by token."""
    import regex

    from fnatlas.llm.decontaminate import EDGE, NAME, NUMBER, UNIT  # fixed patterns

    slots = ("<num>", "<unit>", "<name>")
    bare = lambda w: regex.sub(EDGE, "", w).lower()

    def canonical(text: str) -> list[str]:
        for pattern, sign in zip((NUMBER, UNIT, NAME), slots, strict=True):
            text = regex.sub(pattern, sign, text)
        return W.findall(regex.sub(EDGE, "", text).lower())

    out = {}
    for item, asked in items:
        tokens, raw = canonical(asked), W.findall(asked)
        size = min(8, len(tokens))
        windows = {i: tokens[i : i + size] for i in range(len(tokens) - size + 1)} if len(tokens) >= 4 else {}
        windows = {i: w for i, w in windows.items() if sum(t not in slots for t in w) >= min(5, size)}
        by_word = not windows
        if by_word:
            tokens = [bare(w) for w in raw]
            size = min(8, len(tokens))
            windows = {i: tokens[i : i + size] for i in range(len(tokens) - size + 1)} if tokens else {}
        for doc, text in rows:
            seen, spoken = [bare(w) for w in W.findall(text)] if by_word else canonical(text), W.findall(text)
            met: dict[int, set[int]] = {}
            for p in range(len(seen) - size + 1):
                for i, w in windows.items():
                    if seen[p : p + size] == w:
                        met.setdefault(p - i, set()).add(i)
            for shift, found in met.items():
                if len(found) < 0.5 * len(windows):
                    continue
                pairs = set() if by_word else {(bare(raw[i]), bare(spoken[i + shift])) for i in range(min(found), min(max(found) + 8, len(tokens))) if tokens[i] in slots}
                if len({a for a, _ in pairs}) < len(pairs):
                    continue  # one value of the item stands for two
                kind = "verbatim" if all(a == b for a, b in pairs) else "reparameterised"
                out[doc, item] = max(out.get((doc, item), (0, 0, "")), (len(found), len(windows), kind))
    return out
