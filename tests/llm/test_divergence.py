import re
from collections import Counter, defaultdict

import pytest
from structura.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, value string, item string"


def brute(rows, least=3, top=200):
    docs = [(s or "", g or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", x or "")]) for x, s, g in rows]
    seen, count, total = Counter(), Counter(), Counter()
    for lang, source, terms in docs:
        seen.update((lang, t) for t in set(terms))
        count.update((lang, source, t) for t in terms)
        total.update((lang, t) for t in terms)
    groups, kept = defaultdict(set), defaultdict(list)
    for lang, source, _ in docs:
        groups[lang].add(source)
    for (lang, t), d in seen.items():
        if d >= least:
            kept[lang].append(t)
    out = []
    for lang, sources in groups.items():
        words = kept[lang]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(words)) for t in words}  # noqa: E731, B023
        whole = share({t: total[lang, t] for t in words})
        by = {s: share({t: count[lang, s, t] for t in words}) for s in sources}
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pair = [(sum(f(by[s][t], by[o][t]) for t in words), o) for o in sources - {s}]
            term = [(f(by[s][t], whole[t]), t) for t in words if count[lang, s, t] and by[s][t] > whole[t]]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k) for k, (v, i) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(None, None, None)],
        [("a b", "en", "x"), (None, "en", "y"), ("12 %", None, "x"), ("", None, None)],
        [("Alpha beta_Gamma ÄÉ ä", "en", s) for s in ("x", "x", "y", "z")] + [("beta " * k, "en", "w") for k in range(1, 9)] + [("alone", "de", "x")],
        [("tie one two", "en", s) for s in "abc"] * 3 + [("one", "en", "d"), ("日本 é\U0001f600x", "en", "d")] * 3,
        [(" ".join(f"t{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(i % 7, 400, 1 + i % 5)), ("hot", "hot", "cold")[i % 3], f"s{i % 6}") for i in range(60)],
        [("long " * 50_000 + "tail", "en", "a"), ("long tail", "en", "b"), ("tail long", "en", "b")],
    ],
)
def test_against_brute_force(spark, rows):
    frame = spark.createDataFrame([(i, t, lang, s, "x", 1, "v", "i") for i, (t, lang, s) in enumerate(rows)], SCHEMA)
    got = sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in divergence.audit(frame, salts=3).collect())
    assert got == brute(rows)


def test_only_the_strongest_terms(spark):
    rows = [(" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(20 * i, 20 * i + 60)), "en", "ab"[i % 2]) for i in range(12)] * 3
    frame = spark.createDataFrame([(i, t, lang, s, "x", 1, "v", "i") for i, (t, lang, s) in enumerate(rows)], SCHEMA)
    got = sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in divergence.audit(frame, top_terms=20).collect())
    assert got == brute(rows, top=20)
