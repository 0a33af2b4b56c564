"""Plain Python answers for small tables."""

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np


class Union(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self[b] = a


def words(text, lower=False):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def shingles(text, width=5):
    w = words(text, lower=True)
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def close(a, b, percent):
    both = len(a & b)
    return bool(both) and 100 * both >= percent * (len(a) + len(b) - both)


def near_documents(docs, percent=85):
    """doc_id -> (n_shingles, component_id)."""
    sets, u = {i: shingles(t) for i, t in docs.items()}, Union()
    for a, b in combinations(sorted(sets), 2):
        if close(sets[a], sets[b], percent):
            u.join(a, b)
    return {i: (len(s), u.root(i)) for i, s in sets.items()}


def thin_lines(docs, percent=80, width=8):
    """doc_id -> text with one line of each component."""
    normal = lambda x: x.encode().lower().strip(b" \t\n\v\f\r").decode()
    places = defaultdict(list)
    for i, t in docs.items():
        for n, line in enumerate((t or "").split("\n")):
            if normal(line):
                places[normal(line)].append((i, n))
    sets = {x: {x[k : k + width] for k in range(max(1, len(x) - width + 1))} for x in places}
    u = Union()
    for a, b in combinations(sorted(sets), 2):
        if close(sets[a], sets[b], percent):
            u.join(a, b)
    first = {}
    for x, at in places.items():
        first[u.root(x)] = min(first.get(u.root(x), min(at)), min(at))
    stay = set(first.values())
    return {i: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if not normal(x) or (i, n) in stay) for i, t in docs.items()}


def cut_repeats(docs, width=50):
    """doc_id -> (n_words, n_removed, sha256 of the kept words)."""
    first, split = {}, {i: words(t) for i, t in docs.items()}
    for i in sorted(split):
        for p in range(len(split[i]) - width + 1):
            first.setdefault(tuple(split[i][p : p + width]), i)
    out = {}
    for i, w in split.items():
        dead = set()
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < i:
                dead |= set(range(p, p + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in dead)
        out[i] = (len(w), len(dead), hashlib.sha256(kept).hexdigest())
    return out


ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    """Base spans as kind:start:end."""
    found = []
    for k, (kind, pattern, group, least) in enumerate((("assign", ASSIGN, 1, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return [x for _, _, x in sorted(found)]


def unigram(docs, folds=7, held=2):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score)."""
    out = lambda i: zlib.crc32(str(i).encode()) % folds == held
    tokens = {i: [*words(t, lower=True), b"\n"] for i, t in docs.items()}
    c = Counter(w for i, ws in tokens.items() if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (out(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens.items()}


def heuristics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = [x.decode() for x in words(text)]
    lines = [x for x in text.split("\n") if words(x)]
    where = defaultdict(list)
    for p in range(len(w) - 2):
        where[tuple(w[p : p + 3])].append(p)
    again = {p + k for at in where.values() if len(at) > 1 for p in at for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def nearest(vectors, queries, k=10):
    """query -> [(vec_id, distance)] from id -> vector."""
    out = {}
    for q in queries:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(vectors[q])) ** 2).sum())), i) for i, v in vectors.items() if i != q)
        out[q] = [(i, x) for x, i in d[:k]]
    return out


def least_padding(lengths, buckets):
    """Least padding over all choices of boundaries."""
    distinct = sorted(set(lengths))
    best = math.inf
    for r in range(min(buckets, len(distinct))):
        for inner in combinations(distinct[:-1], r):
            ends = [*inner, distinct[-1]]
            best = min(best, sum(next(e for e in ends if e >= x) - x for x in lengths))
    return best


def merkle_tree(leaves):
    """Levels of a tree from its leaves up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def merkle(rows, lower):
    """(doc_id, leaf, subroot, root, proof_sha256, verified) of (doc_id, source, lang, n_chars, text) rows; ``lower``: whose text is tampered with."""
    leaf = lambda r: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: merkle_tree([x[2] for x in sorted(groups[k], key=lambda x: x[:3])]) for k in keys}
    top, out = merkle_tree([trees[k][-1][0] for k in keys]), []
    for t, k in enumerate(keys):
        for i, (_, _, h, r) in enumerate(sorted(groups[k], key=lambda x: x[:3])):
            others = []
            for levels, at in ((trees[k], i), (top, t)):
                for level in levels[:-1]:
                    run = at // 8 * 8
                    others += level[run:at] + level[at + 1 : run + 8]
                    at //= 8
            same = not lower(r[0]) or r[4] is None or not any("A" <= c <= "Z" for c in r[4])
            out.append((r[0], h, trees[k][-1][0], top[-1][0], sha("".join(others)), same))
    return out


def cheapest_edits(rows):
    """(cost, audit) of (initial, fault) rows by the cheapest path over strings of initials; faults: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        if (i, roles) in seen or not re.fullmatch("s?(ua)*u?", roles):
            continue
        seen.add((i, roles))
        for x in "ua":
            heapq.heappush(heap, (cost + 3, audit + "I", i, roles + x))
        if i < len(rows):
            role, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles))
            if fault in (0, 3):
                heapq.heappush(heap, (cost + fault, audit + "K", i + 1, roles + role))
                for x in "ua":
                    heapq.heappush(heap, (cost + 3 + fault, audit + "R", i + 1, roles + x))


def repaired_conversations(rows):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)} of (conv_id, turn, role, text) rows, by the rules one after another."""
    out, given = {}, {}
    for conv, turn, role, text in rows:
        kept = given.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, found in given.items():
        found.sort()
        seen, faults = set(), []
        for _, _, role, text in found:
            last = re.sub(r"[\x20\x09-\x0D]", "", text)[-1:]
            faults.append(1 if not last else 2 if (role, text) in seen else 0 if last in ".!?" else 3)
            seen.add((role, text))
        initials = [r[2][:1] if r[2][:1] in ("s", "u", "a") else "x" for r in found]
        cost, audit = cheapest_edits(list(zip(initials, faults)))
        left, roles, at = [], "", 0
        for e in audit:
            wanted = "assistant" if roles.endswith("u") else "user"
            if e != "I":
                _, _, role, text = found[at]
                at += 1
            if e == "D":
                continue
            role, text = (role, text) if e == "K" else (wanted, text if e == "R" else "")
            roles += role[0]
            left.append(f"{role}:{text}")
        turns = {r[1] for r in found if r[0]}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, sha("\n".join(left)))
    return out


class KneserNey:
    """Interpolated Kneser-Ney over characters, straight from its definition."""

    def __init__(self, words, order, edge, discount=0.75):
        self.order, self.edge, self.discount = order, edge, discount
        self.counts = {order: Counter()}
        for w in words:
            s = edge * (order - 1) + w + edge
            self.counts[order].update(s[i : i + order] for i in range(len(s) - order + 1))
        for n in range(order - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in set(self.counts[n + 1]))

    def chance(self, gram):
        """Of the last character after the others."""
        if not gram:
            return 1 / (len(self.counts[1]) + 1)
        table = self.counts[len(gram)]
        after = [c for g, c in table.items() if g[:-1] == gram[:-1]]
        lower = self.chance(gram[1:])
        if not after:
            return lower
        return max(table[gram] - self.discount, 0) / sum(after) + self.discount * len(after) / sum(after) * lower

    def log_chance(self, words):
        total = 0.0
        for w in words:
            s = self.edge * (self.order - 1) + w + self.edge
            total += sum(math.log(self.chance(s[i : i + self.order])) for i in range(len(s) - self.order + 1))
        return total
