"""Plain versions of the corpus operators, written from their contracts."""

import collections
import hashlib
import math
import re
import zlib

from tokenizers import Tokenizer


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def encoded(path, text):
    tokenizer = Tokenizer.from_file(path)
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


def lm_scores(docs, mass):
    """Per row (held_out, n_tokens, n_known, train_tokens, base, score)."""
    tokens = [[*words(low(t or "")), None] for _, t in docs]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in docs]
    counts, texts = collections.Counter(), 0
    for w, h in zip(tokens, held, strict=True):
        if not h:
            texts += 1
            padded = ["<s>", "<s>", *w]
            for k in (1, 2, 3):
                counts.update(tuple(padded[j - k + 1:j + 1]) for j in range(2, len(padded)))
    single = {g: c for g, c in counts.items() if len(g) == 1}
    n, v = sum(single.values()), len(single)

    def chance(context, x):
        if not context:
            return (counts[x,] + 1) / (n + v + 1)
        seen = texts if set(context) == {"<s>"} else counts[context]
        return (counts[*context, x] + mass[len(context)] * chance(context[1:], x)) / (seen + mass[len(context)])

    rows = []
    for w, h in zip(tokens, held, strict=True):
        padded = ["<s>", "<s>", *w]
        score = sum(math.log10(chance(tuple(padded[j - 2:j]), padded[j])) for j in range(2, len(padded)))
        rows.append((h, len(w), sum(counts[x,] > 0 for x in w), n, sum(math.log10(chance((), x)) for x in w), score))
    return rows


def license_places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))
    places, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        found = [k for k in range(len(w) - len(p) + 1) if w[k:k + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def license_labels(text, statements, threshold):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))
    found, best = set(), 0.0
    for statement, label in statements:
        own, size = set(statement.split()), len(statement.split())
        for k in range(max(1, len(w) - size + 1)):
            share = len(own & set(w[k:k + size])) / len(own)
            if share >= threshold - 1e-9:
                found.add(label)
                best = max(best, share)
    return found, best


def repeats(docs, n=100):
    seen, out = set(), {}
    for i, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - n + 1):
            s = raw[p:p + n]
            if s in seen:
                gone[p:p + n] = b"\1" * n
            seen.add(s)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    runs = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    inside = {k for i in range(len(w) - 7) if runs[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
    base = len(w) < 20 or 100 * len(inside) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), base)


def groups(docs, size=5, share=75):
    sets = {}
    for i, t in docs:
        w = words(low(t or ""))
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= share * (len(sets[a]) + len(sets[b]) - shared):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def infill(i, text, seed=1):
    """(n, form, prefix_chars, middle_chars, output) of one text, token by token."""
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(tokens), "plain", None, None, text
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 20:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def lloyd(vectors, parts=8, entries=16, rounds=6, scale=4096):
    """Per vector (code, error), and the codebooks, in plain integers. ``vectors``: id, components, by ascending id."""
    whole = [[math.floor(scale * x) for x in v] for _, v in vectors]
    width = len(whole[0]) // parts
    cut = [[v[k * width:(k + 1) * width] for v in whole] for k in range(parts)]
    books = [own[:entries] for own in cut]

    def nearest(part, book):
        far = [sum((x - y) ** 2 for x, y in zip(part, e, strict=True)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for k, own in enumerate(cut):
            members = collections.defaultdict(list)
            for part in own:
                members[nearest(part, books[k])[0]].append(part)
            books[k] = [[sum(c) // len(members[e]) for c in zip(*members[e], strict=True)] if e in members else old for e, old in enumerate(books[k])]
    found = [[nearest(own[i], books[k]) for k, own in enumerate(cut)] for i in range(len(whole))]
    return [("".join(f"{e:02x}" for e, _ in f), sum(d for _, d in f)) for f in found], books


def plain_runs(rows):
    """Per id the kept text and the number of removed lines."""
    places, texts, out = collections.defaultdict(list), {}, {}
    for i, text in rows:
        texts[i] = lines = (text or "").split("\n")
        gone = set()
        for q, line in enumerate(lines):
            if not line.strip():
                continue
            for j, p in places[line]:
                old, n = texts[j], 0
                most = q - p if j == i else len(lines)
                while n < most and q + n < len(lines) and p + n < len(old) and lines[q + n] == old[p + n]:
                    n += 1
                while n and not lines[q + n - 1].strip():
                    n -= 1
                if sum(1 for x in lines[q:q + n] if x.strip()) >= 2:
                    gone.update(range(q, q + n))
            places[line].append((i, q))
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone) if text is not None else None, len(gone))
    return out
