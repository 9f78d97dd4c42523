"""The hand-checked reviews, and an independent list-based computation of every result."""

from collections import defaultdict

# (item, user, score, up, total, time, body length)
MICRO = [
    ("A", "u1", 5, 8, 10, 1041379200, 0),
    ("A", "u2", 5, 9, 10, 1041379201, 1023),
    ("A", "u3", 4, 0, 0, 1199145600, 1024),
    ("B", "u1", 3, 1, 3, 1199145601, 2048),
    ("B", "u2", 3, 2, 3, 0, 2047),
    ("B", "u4", 3, 5, 5, 1230768000, 5000),
    ("C", "u2", 2, 0, 4, 1230768000, 100),
    ("C", "u3", 1, 4, 4, 1262304000, 100),
    ("C", "u5", 2, 0, 0, 1262303999, 100),
    ("D", "u3", 4, 1, 1, 946684800, 3000),
    ("A", "u4", 4, 6, 10, 946684799, 10),
    ("A", "u4", 5, 7, 10, 946684801, 10),
    ("E", "u4", 2, 0, 0, 1300000000, 0),
]

SCHEMA = """item_id string, user_id string, score double, up_votes bigint, total_votes bigint,
review_time bigint, body_length bigint, helpful_pct bigint"""


def frame(spark, rows):
    data = [
        (i, u, float(s), up, total, t, n, up * 100 // total if total else None)
        for i, u, s, up, total, t, n in rows
    ]
    return spark.createDataFrame(data, SCHEMA)


class Brute:
    """Plain Python over the rows, pair by pair, following the definitions."""

    def __init__(self, rows):
        self.by_user = defaultdict(list)
        for i, u, s, up, total, t, n in rows:
            self.by_user[u].append((i, float(s), t, up * 100 // total if total else None))
        self.help = {
            u: float(sum(r[3] or 0 for r in rs) // len(rs)) for u, rs in self.by_user.items()
        }
        self.latest = {}
        for u, rs in self.by_user.items():
            best = {}
            for i, s, t, _ in rs:
                best[i] = max(best.get(i, (t, s)), (t, s))
            self.latest[u] = {i: s for i, (t, s) in best.items()}

    def degree(self, a, b):
        gaps = [abs(s - self.latest[b][i]) for i, s, _, _ in self.by_user[a] if i in self.latest[b]]
        return sum(gaps) / len(gaps) if gaps else None

    def overlap(self, a, b):
        return sum(1 for r in self.by_user[a] for q in self.by_user[b] if r[0] == q[0])

    def edges(self, threshold):
        out = {}
        for a in self.by_user:
            for b in self.by_user:
                d = self.degree(a, b) if a != b else None
                if d is not None and d <= threshold:
                    out[a, b] = d
        return out

    def peer_rank(self, weight):
        gains = defaultdict(list)
        for (a, b), d in self.edges(0.9).items():
            gain = self.help[b] - self.help[a]
            if gain > 0:
                gains[a].append((d if weight == "divergence" else 1 - d) * gain)
        return {u: h + (sum(gains[u]) / len(gains[u]) if u in gains else 0) for u, h in self.help.items()}

    def suggest(self, neighbours, exclude_seen=False):
        votes = defaultdict(list)
        for a, b in self.edges(0.0):
            if neighbours == "multi" and len(self.by_user[b]) < 2:
                continue
            for i, s, _, _ in self.by_user[b]:
                votes[a, i] += [s] * (self.overlap(a, b) if neighbours == "overlap" else 1)
        return {
            (u, i): sum(v) / len(v)
            for (u, i), v in votes.items()
            if not (exclude_seen and i in self.latest[u])
        }
