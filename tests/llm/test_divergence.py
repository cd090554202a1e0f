"""The divergence audit against sums over every kept term, on rows of all kinds."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import oracle

from footfall.llm import divergence, queries

DOC = "doc_id long, text string, lang string, source string, n_chars long, term string, value string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def frame(spark, data):
    return spark.createDataFrame([(i, *d, 0, "t", "v") for i, d in enumerate(data)], DOC)


def audited(data, least=10, top=10):
    """By dictionaries over all terms of all sources."""
    lower = str.maketrans(divergence.UPPER, divergence.LOWER)
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(lower))) for text, lang, source in data]
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        seen[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        p_of = lambda count: {t: 1 + 10**9 * (count[t] + 2) // (sum(count[k] for k in kept) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: p_of(counts[lang, s]) for s in sources}
        q = p_of(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item, -v, r + 1) for part, rows in (("pair", pairs), ("term", terms)) for r, (v, _, item) in enumerate(rows)]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def made(n=600, seed=5):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ab", "Été", "ZZ", "日本", "o\u0085o", "_x") for b in ("", "k", "É", "q q", "7m")]
    data = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(["a", "a", "b", "É", None, "", "𝒳"])
        data.append((" ".join(rng.choices(words[: 6 + 4 * len(source or "")] + ["common"] * 9, k=rng.randrange(40))), lang, source))
    odd = [(None, "en", "only null"), ("", "en", "empty"), ("12 34 \x00 [", "en", "no term"), ("rare words here", "fr", "a"), ("others", "fr", "b"), ("single", "xx", "one"), ("long " * 60_000, "en", "a")]
    return data + odd + data[:5]


def test_audit_is_the_sum_over_every_kept_term(spark):
    data = made()
    df = frame(spark, data).repartition(5)
    assert rows(divergence.audit(df)) == audited(data)
    assert rows(divergence.audit(df, least=1, top=3)) == audited(data, 1, 3)


def test_audit_in_small_portions(spark, monkeypatch):
    """Counts that are passed on early, slices of few texts and many shards change nothing."""
    for name, value in (("GATHERED", 40), ("TEXT", 300), ("SHARD", 9)):
        monkeypatch.setattr(divergence, name, value)
    data = made(250, 6)
    assert rows(divergence.audit(frame(spark, data).repartition(2))) == audited(data)


def test_audit_of_nothing(spark):
    assert rows(divergence.audit(frame(spark, []))) == []
    assert rows(divergence.audit(frame(spark, [(None, None, None)]))) == []
    few = [("a b", "en", "x"), (None, "en", "y")]
    assert rows(divergence.audit(frame(spark, few))) == audited(few) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_audit_sql(spark, sf_dir):
    con = oracle.connect(sf_dir)
    assert oracle.assert_same(queries.QUERIES["op12_divergence_audit"](spark, sf_dir), queries.SQL["op12_divergence_audit"], con) > 0
