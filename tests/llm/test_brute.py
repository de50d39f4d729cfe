"""Whole queries of toxicity and wrapper induction against plain versions, without numpy, hashes or Spark."""

import math
import random
import re
from collections import Counter
from html.parser import HTMLParser

import pytest

from tidemill.llm import toxicity, wrapper

from .test_operators import DOCS, clash, prose


def tokens_of(text):
    """(words, word beginnings of STEM bytes) of a text."""
    own = re.findall(r"[0-9a-z\x80-￿]+", (text or "").lower())
    return own, [w.encode()[: toxicity.STEM] for w in own]


def brute_model(rows, labels):
    """(scores of words and stems, background, lambda) by counting."""
    toxic = {}
    for i, t in labels:
        if i is not None and t is not None:
            toxic[i] = max(toxic.get(i, 0), t)
    texts = {}
    for i, text in rows:
        if i in toxic:
            own, stems = tokens_of(text)
            key = tuple(own)
            texts[key] = (max(toxic[i], texts.get(key, (0,))[0]), {("w", w) for w in own} | {("s", s) for s in stems})
    tox, clean = Counter(), Counter()
    for t, own in texts.values():
        (tox if t > 0 else clean).update(own)
    n_tox, n_clean = sum(tox.values()), sum(clean.values())
    total, scores, p = n_tox + n_clean, {}, {}
    for k in tox:
        if tox[k] < 3 or tox[k] * n_clean <= 4 * clean[k] * n_tox:
            continue
        a0 = toxicity.PRIOR * total
        a = a0 * (tox[k] + clean[k]) / total
        odds = math.log((tox[k] + a) / (n_tox + a0 - tox[k] - a)) - math.log((clean[k] + a) / (n_clean + a0 - clean[k] - a))
        if odds / math.sqrt(1 / (tox[k] + a) + 1 / (clean[k] + a)) >= toxicity.MIN_Z and odds > 2 * toxicity.GAP:
            scores[k] = odds - toxicity.GAP
    for k in scores:
        p[k] = (clean[k] + 0.5 / len(scores)) / (n_clean + 1)
    rest = max(1e-9, 1 - sum(p.values()))
    f = lambda lam: sum(p[k] * math.exp(min(700, lam * s)) for k, s in scores.items()) + rest * math.exp(-lam * toxicity.GAP) - 1
    lo, hi = 0.0, 1.0
    while f(hi) < 0:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return scores, -toxicity.GAP, lo


def brute_p(text, model):
    scores, background, lam = model
    own, stems = tokens_of(text)
    s = [max(scores.get(("w", w), 0), scores.get(("s", t), 0)) or background for w, t in zip(own, stems)]

    def split(a, b):
        """All maximal scoring segments of s[a:b], by their definition."""
        best = max(((sum(s[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i, j = best[3:]
        return [*split(a, i), best[0], *split(j, b)]

    xs = sorted((x for v in split(0, len(s)) if (x := lam * v - math.log(max(len(own), 1))) > 0), reverse=True)
    return toxicity.tail(xs)


def test_toxicity_equals_brute_force(spark):
    rng = random.Random(14)
    bad = ["vilescum", "rotgut", "dimwit", "foulish"]

    def text(n, k):
        w = prose(rng, n).split()
        for p in rng.sample(range(len(w)), k):
            w[p] = rng.choice(bad) + rng.choice(["", "s", "ed"])
        return " ".join(w)

    rows = [(i, text(rng.randrange(8, 40), rng.randrange(3, 7) if i % 5 == 0 else 0)) for i in range(300)]
    rows += [(300 + i, text(30, i % 7)) for i in range(40)] + [(400, None), (401, ""), (402, rows[0][1].upper()), (0, rows[1][1]), (None, rows[0][1])]
    labels = [(i, int(i % 5 == 0)) for i in range(200)] + [(402, 0), (5, 0), (None, 1), (6, None)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS).repartition(3)
    model = toxicity.fit(clash(docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    want = brute_model(rows, labels)
    assert model.lam == pytest.approx(want[2]) and sorted(model.scores) == pytest.approx(sorted(want[0].values())) and len(want[0]) >= 4
    got = sorted(((r.doc_id is None, r.doc_id or 0, round(r.p_value, 9), r.toxic, r.n_words) for r in toxicity.passages(clash(docs), model).collect()))
    again = sorted((i is None, i or 0, round(brute_p(t, want), 9), brute_p(t, want) < toxicity.P_VALUE, len(tokens_of(t)[0])) for i, t in rows)
    assert got == again and 50 < sum(r[3] for r in got) < 120


def test_toxic_passages_of_very_long_texts_and_ties(spark):
    rng = random.Random(15)
    rows = [(i, " ".join([prose(rng, 20), *["vilescum rotgut"] * (2 * (i % 2)), prose(rng, 20)])) for i in range(200)]
    model = toxicity.fit(spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS), spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int"))
    long = prose(rng, 150_000)
    half = len(long) // 2
    docs = [(0, long), (1, long + " vilescum" * 40), (1, long + " vilescum" * 40), (2, long[:half] + " vilescum rotgut" * 20 + " " + long[half:])]
    got = sorted((r.doc_id, r.toxic, len(r.segments)) for r in toxicity.passages(spark.createDataFrame([(i, t, "en") for i, t in docs], DOCS), model).collect())
    assert got == [(0, False, 0), (1, True, 1), (1, True, 1), (2, True, 1)]


class Plain(HTMLParser):
    """A page's nodes as (label, parent) and texts, for well-formed pages."""

    def __init__(self, html):
        super().__init__()
        self.nodes, self.stack = [("#root", -1, "")], [0]
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        kind = dict(attrs).get("class")
        self.nodes.append((f"{tag}.{kind}" if kind else tag, self.stack[-1], ""))
        self.stack.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        if data.strip():
            self.nodes.append(("#", self.stack[-1], data.strip()))


def brute_matching(a, b):
    """Pairs of a largest simple tree matching, by trying all: more equal texts break ties; the trees are small."""
    kids = lambda t, x: [i for i, n in enumerate(t) if n[1] == x]

    def best(x, y):
        def go(xs, ys):
            if not xs or not ys:
                return (0, 0), []
            out = [go(xs[1:], ys), go(xs, ys[1:])]
            if a[xs[0]][0] == b[ys[0]][0]:
                (s, pairs), (r, more) = best(xs[0], ys[0]), go(xs[1:], ys[1:])
                out.append(((s[0] + r[0], s[1] + r[1]), pairs + more))
            return max(out, key=lambda v: v[0])

        score, pairs = go(kids(a, x), kids(b, y))
        return (score[0] + 1, score[1] + (a[x][2] == b[y][2])), [(x, y), *pairs]

    return best(0, 0)[1]


def brute_extract(rows):
    """page id -> content lines: every rule of the operator by counting over whole lists of pages."""
    pages = {i: Plain(html).nodes for i, _, html in rows}
    host = {i: url.split("/")[2] for i, url, _ in rows}

    def path(t, i):
        return (*(path(t, t[i][1]) if t[i][1] >= 0 else ()), t[i][0])

    layout = {i: frozenset(p for k in range(len(t)) if t[k][0] != "#" and len(p := path(t, k)) <= wrapper.LEVELS) for i, t in pages.items()}
    out = {}
    for i, t in pages.items():
        same = sorted(j for j in pages if host[j] == host[i])
        like = [j for j in same if layout[j] == layout[i]]
        sizes = sorted(len(pages[j]) for j in like)
        middle = (sizes[(len(sizes) - 1) // 2] + sizes[len(sizes) // 2]) / 2
        ref = min((len(pages[j]), j) for j in like if len(pages[j]) >= middle)[1]
        template = set()
        # by place in the layout
        slots = {j: {y: x for x, y in brute_matching(pages[ref], pages[j]) if pages[j][y][0] == "#"} for j in like}
        for y, x in slots[i].items():
            texts = Counter(pages[j][v][2] for j in like for v, u in slots[j].items() if u == x)
            n, there = texts[t[y][2]], sum(texts.values())
            if len(like) >= wrapper.LEAST_PAGES and n >= wrapper.LEAST_PAGES and there >= wrapper.SUPPORT * len(like) and n >= wrapper.CONSTANT * there:
                template.add(y)
        # by path on the host
        for y in (k for k, n in enumerate(t) if n[0] == "#"):
            p = path(t, y)
            there = sum(any(n[0] == "#" and path(pages[j], k) == p for k, n in enumerate(pages[j])) for j in same)
            n = sum(any(m[0] == "#" and m[2] == t[y][2] and path(pages[j], k) == p for k, m in enumerate(pages[j])) for j in same)
            if len(same) >= wrapper.LEAST_PAGES and there >= wrapper.SUPPORT * len(same) and n >= wrapper.CONSTANT * there:
                template.add(y)
        out[i] = "\n".join(n[2] for k, n in enumerate(t) if n[0] == "#" and k not in template)
    return out


def test_wrapper_equals_brute_force(spark):
    rng = random.Random(16)

    def page(kind):
        nav = "".join(f"<li>{x}</li>" for x in ("Home", "News", "About") if rng.random() < 0.9)
        body = "".join(f"<p>{prose(rng, 3)}</p>" for _ in range(rng.randrange(1, 4)))
        extra = f'<div class="note">{rng.choice(["Login", "Login", "Login", "Logout"])}</div>' if rng.random() < 0.8 else ""
        side = f"<section><b>{rng.choice(['Top', 'Top', prose(rng, 2)])}</b></section>" if kind else ""
        return f"<html><body><ul>{nav}</ul>{extra}<div>{body}</div>{side}<div class=\"foot\">(c) Shop</div></body></html>"

    rows = [(i, f"http://{'ab'[i % 2]}.example/{i}", page(i % 3 == 0)) for i in range(24)] + [(90, "http://c.example/1", page(0)), (91, "http://c.example/2", page(0))]
    got = {r.page_id: r.content for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    want = brute_extract(rows)
    assert got == want
    # by joins, as for more references than may be broadcast
    assert {r.page_id: r.content for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), small_bytes=0).collect()} == want
    assert any("Home" not in c for c in want.values()) and any("Logout" in c for c in want.values())


def test_wrapper_of_repeated_null_and_very_long_pages(spark):
    rng = random.Random(17)
    item = lambda k: f"<tr><td>{k}</td><td>{prose(rng, 2)}</td></tr>"
    head, foot = "<html><body><ul><li>Home<li>About</ul><table>", "</table><p>(c) Shop</p></body></html>"
    rows = [(i, "http://x.example/", head + "".join(item(f"{i}-{k}") for k in range(4)) + foot) for i in range(6)]
    rows += [rows[0], (None, "http://x.example/", rows[1][2]), (7, "http://x.example/", head + "".join(f"<tr><td>cell</td><td>{k}</td></tr>" for k in range(1500)) + foot), (8, "http://x.example/", "<div>" * 5000 + "deep")]
    got = wrapper.extract(spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, layout int, `n.x` string")).collect()
    assert len(got) == len(rows) and sum(r.page_id == 0 for r in got) == 2 and sum(r.page_id is None for r in got) == 1
    assert all("Home" not in r.content and "Shop" not in r.content for r in got if r.page_id != 8)
    assert next(r for r in got if r.page_id == 7).content.count("\n") > 1400 and next(r for r in got if r.page_id == 8).content == "deep"
