"""Plain-Python models of the operators, row by row."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash

SPACES = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def smallest(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


def exact_groups(rows):
    """Per row (doc_id, keep_id, group_size, sha256 of the normalised text)."""
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    ids = defaultdict(list)
    for (i, _), n in zip(rows, norm):
        ids[n].append(i)
    return [(i, smallest(ids[n]), len(ids[n]), hashlib.sha256(n.encode()).hexdigest()) for (i, _), n in zip(rows, norm)]


def shared_lines(rows, min_docs):
    key = lambda line: line.strip(SPACES).translate(LOWER)
    docs = Counter()
    for _, t in rows:
        docs.update({key(line) for line in (t or "").split("\n")})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [line for line in lines if not (key(line) and docs[key(line)] >= min_docs)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def fingerprint(text, n=4):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def link_roots(prints, most):
    """The smallest place reachable from each place over links of at most ``most`` bits."""
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= most and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(len(prints))]


def near_groups(rows, most=4):
    """Per row (doc_id, fingerprint in hex, component_id)."""
    prints = [fingerprint(t) for _, t in rows]
    roots = link_roots(prints, most)
    ids = defaultdict(list)
    for (i, _), r in zip(rows, roots):
        ids[r].append(i)
    return [(i, f"{p:016x}", smallest(ids[r])) for (i, _), p, r in zip(rows, prints, roots)]


def base_counts(text):
    text = text or ""
    w, seen, dup = words(text), set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(line.strip(SPACES))
        seen.add(line)
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def license_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    starts, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def packed_ids(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def filter_audit(rows, labels):
    """Rows of the audit, every order run over all documents; ``rows``: (doc_id, text, part)."""
    from itertools import permutations

    lowest = {}
    for i, t, _ in rows:
        if i is not None:
            lowest[t or ""] = min(i, lowest.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    docs = []
    for i, t, part in rows:
        t = t or ""
        w = words(t)
        fails = "".join(f for f, failed in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            any(c in "#$%&*|" for c in t), i is not None and lowest[t] < i)) if failed)
        docs.append((part or "", i, fails))
    out = {}
    for part in {p for p, _, _ in docs}:
        own = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[2]]
                left = [d for d in left if f not in d[2]]
                failing = [d for d in own if f in d[2]]
                out[(part, order, k + 1)] = [len(left), len(gone), len(failing) - len(gone), sum(d[2] == f for d in own),
                                             sum(d[1] in good for d in gone), sum(d[1] in toxic for d in gone)]
    shapley = Counter()
    for (part, order, step), r in out.items():
        shapley[(part, order[step - 1])] += r[1]
    return Counter((*key, *r, shapley[(key[0], key[1][key[2] - 1])]) for key, r in out.items())


def collocations(rows, most_words, least, percent, most):
    """Rows (lang, rank, phrase, a, l, r, n, score); ``rows``: (lang, text)."""
    count, size = Counter(), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (t or "").translate(LOWER)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            size[lang] += len(w)
            for k in range(1, most_words + 1):
                count.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    chosen = {key: a for key, a in count.items() if len(key[1]) > 1 and a >= least}
    found = defaultdict(list)
    for (lang, w), a in chosen.items():
        longer = [b for (x, v), b in chosen.items() if x == lang and len(v) > len(w)
                  and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1)) and 100 * b >= percent * a]
        if longer:
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = count[(lang, w[:k])], count[(lang, w[k:])]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return Counter((lang, i + 1, p.decode(), -a, left, right, size[lang], -score)
                   for lang, rows in found.items() for i, (score, a, p, left, right) in enumerate(sorted(rows)[:most]))


def spots(text, anchors, chain=3, skipped=8, few=16):
    """The signatures of a text, as strings."""
    import regex

    w = regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower())
    if not w:
        return {text or ""}
    out = set()
    for i, x in enumerate(w):
        if x in anchors:
            taken, passed = [], 0
            for y in w[i + 1:]:
                if y in anchors:
                    passed += 1
                    if passed > skipped:
                        break
                    continue
                passed = 0
                taken.append(y)
                if len(taken) == chain:
                    break
            if taken:
                out.add(" ".join([x, *taken]))
        elif i + chain < len(w) and not any(y in anchors for y in w[i:i + chain + 1]):
            out.add(" ".join(w[i:i + chain + 1]))
    return out | set(w) if len(out) < few else out


def spot_rows(rows, anchors):
    """Per row in order of ids: (doc_id, n_chars, sha of the edited text, near_edited, near_next, signatures, edited ones)."""
    out = []
    likeness = lambda a, b: len(a & b) / len(a | b)
    texts = [t or "" for _, t in rows]
    for (i, _), t, nxt in zip(rows, texts, texts[1:] + texts[:1]):
        k = len(t) // 4
        edited = t[:len(t) - k] + nxt[:k]
        a, b, c = (spots(x, anchors) for x in (t, edited, nxt))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), likeness(a, b), likeness(a, c), a, b))
    return out
