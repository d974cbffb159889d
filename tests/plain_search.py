"""The question path over plain Python lists: index, tiers, lanes, blend."""

import math
import re
from collections import Counter

from tidelog.config import STOP_WORDS

FIELDS = ("title", "text", "summary", "note", "tags", "labels", "app", "window", "url", "path")


def unique(xs):
    return list(dict.fromkeys(xs))


def phrases(q):
    out = [t for w in q.lower().split() if (t := tuple(re.findall(r"[^\W_]+", w)))]
    return unique([p for p in out if not (len(p) == 1 and (p[0] in STOP_WORDS or len(p[0]) == 1))] or out)


def terms(q):
    every = [t for p in phrases(q) for t in p]
    return unique([t for t in every if t not in STOP_WORDS and len(t) > 1] or every)


class Plain:
    def __init__(self, rows):
        self.rows = {r["id"]: r for r in rows if r.get("status") != "error"}
        self.tokens = {}
        for i, r in self.rows.items():
            parts = [" ".join(r[f]) if isinstance(r.get(f), list) else r[f] for f in FIELDS if r.get(f) is not None]
            self.tokens[i] = re.findall(r"[^\W_]+", "\n".join(parts).lower())
        self.counts = {i: Counter(t) for i, t in self.tokens.items()}
        self.n = len(self.rows)
        self.mean = sum(map(len, self.tokens.values())) / max(self.n, 1)
        self.df = Counter(t for c in self.counts.values() for t in c)

    def adjoins(self, i, p):
        t = self.tokens[i]
        return any(tuple(t[k : k + len(p)]) == p for k in range(len(t) - len(p) + 1))

    def scored(self, ids, words):
        df = Counter(t for i in ids for t in set(words) if t in self.counts[i])

        def part(i, t):
            tf = float(self.counts[i][t])
            idf = math.log((self.n - df[t] + 0.5) / (df[t] + 0.5) + 1)
            return math.floor(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(self.tokens[i]) / self.mean)) * 1e6 + 0.5)

        score = {i: sum(part(i, t) for t in set(words) if t in self.counts[i]) for i in ids}
        return sorted(score, key=lambda i: (-score[i], -i))

    def cohits(self, rare, n):
        found = {i: [t for t in rare if t in c] for i, c in self.counts.items()}
        found = {i: ts for i, ts in found.items() if ts}
        order = sorted(found, key=lambda i: (-len(found[i]), min(self.df[t] for t in found[i]), -self.rows[i]["created_at"].timestamp(), -i))
        return [(i, found[i]) for i in order[:n]]

    def rare(self, q):
        return unique(t for p in phrases(q) for t in [min(p, key=lambda t: (self.df[t], t))] if 0 < self.df[t] <= 0.05 * self.n)

    def search(self, q, n):
        """[(id, tier, rank)]"""
        ps = phrases(q)
        least = {p: min(self.df[t] for t in p) for p in ps}
        use = [p for p in ps if least[p] <= 0.25 * self.n] or ps
        loose = unique(t for p in use for t in p if len(t) > 1)
        out = {}

        def add(ids, tier):
            for rank, i in enumerate(ids[:n]):
                out.setdefault(i, (tier, rank))

        if all(least[p] for p in use):
            ids = [i for i in self.rows if all(self.adjoins(i, p) for p in use)]
            add(self.scored(ids, [t for p in use for t in p]), 1)
            if out and len(ps) < 4:
                return [(i, *x) for i, x in out.items()]
        if len(ps) < 4 and loose and len(loose) != len(use) and all(self.df[t] for t in loose):
            add(self.scored([i for i, c in self.counts.items() if all(t in c for t in loose)], loose), 2)
            if out:
                return [(i, *x) for i, x in out.items()]
        rare = self.rare(q)
        if len(rare) >= 2:
            add([i for i, _ in self.cohits(rare, n)], 3)
        if not out and (unknown := [t for t in loose if not self.df[t]]):
            known = [t for t in loose if self.df[t]]
            ids = [i for i, c in self.counts.items() if all(t in c for t in known) and all(any(w.startswith(t) for w in c) for t in unknown if len(t) >= 2) and all(len(t) >= 2 for t in unknown)]
            add(sorted(ids, key=lambda i: (self.rows[i]["created_at"], i), reverse=True), 4)
        return [(i, *x) for i, x in out.items()]

    def lanes(self, questions, carried, keep):
        best = {}
        legs = [(f"{k:02d}", [(rank + tier * keep, i) for i, tier, rank in sorted(self.search(q, keep), key=lambda x: x[1:])[:keep]]) for k, q in enumerate(unique(questions))]
        legs.append(("zz", list(enumerate(carried[:4]))))
        for leg, hits in legs:
            for rank, i in hits:
                best[i] = min(best.get(i, (math.inf, "")), (rank, leg))
        return sorted(best, key=lambda i: (*best[i], i))[:keep]

    def both(self, i):
        r = self.rows[i]
        return f"{r['title'] or ''}\n{r['text'] or ''}".lower()

    def scan(self, words, n):
        score = {}
        for i, r in self.rows.items():
            body = "\n".join([r["title"] or "", r["text"] or ""]).lower()
            hits = sum((t in body) + (t in (r["title"] or "").lower()) for t in words)
            if hits:
                score[i] = round(hits / math.log2(4 + len(body) / 200), 6)
        return sorted(score, key=lambda i: (-score[i], i))[:n]

    def shaped(self, pattern, words, n):
        score = {}
        for i, r in self.rows.items():
            body = "\n".join([r["title"] or "", r["text"] or ""])
            if re.search(pattern, body):
                score[i] = 3 * bool(re.search(pattern, r["title"] or "")) + (2 if len(body) <= 200 else 1 if len(body) <= 800 else 0) + min(2, sum(t in body.lower() for t in words))
        return sorted(score, key=lambda i: (-score[i], i))[:n]

    def answer(self, questions, turns, asked, shape, pages, keep=24, reserved=3):
        """[(kind, ref)] in order."""
        main = questions[0]
        carried = unique(i for turn in turns[-2:][::-1] for i in turn[:3])[:4]
        flat = ["".join(x.lower().split()) for x in asked]
        echo = {i for i in self.rows if any(len(f) >= 8 and f in re.sub(r"\s+", "", (self.rows[i]["text"] or "").lower()) for f in flat)}
        pool = [i for i in self.rows if i not in echo]
        found = [i for i in self.lanes(questions, carried, keep) if i in pool]
        rare = self.rare(main)
        together = {i for i, ts in self.cohits(rare, 4 * keep) if len(ts) >= 2} if len(rare) >= 2 else set()
        tier = lambda i: 3 if main.lower() in self.both(i) else 0 if i in together else 1 if any(t in self.both(i) for t in terms(main)) else 2
        found = sorted(found, key=tier)
        room = keep - len(pages[:reserved])
        own = Plain.__new__(Plain)
        own.rows = {i: self.rows[i] for i in pool}
        scanned = own.scan(terms(main), keep)
        shaped = own.shaped(shape, terms(main), keep) if shape else []
        first = shaped[: room // 2]
        second = [i for i in found if i not in first][:6]
        rest = unique([*first, *second, *scanned, *found, *shaped])[:room]
        return [("record", str(i)) for i in rest] + [("page", u) for u in pages[:reserved]]
