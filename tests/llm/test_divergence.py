import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from corpusloom.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string"


def plain(rows):
    """The audit stated term by term."""
    docs, counts, in_docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts[lang, source].update(terms)
        in_docs[lang].update(set(terms))
        docs[lang][source] += 1
    out = set()
    for lang, sources in docs.items():
        kept = [t for t, n in in_docs[lang].items() if n >= 10]
        total = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        share = lambda n, whole: 1 + 10**9 * (n + 2) // (whole + 2 * len(kept))  # noqa: E731, B023
        p = {s: {t: share(counts[lang, s][t], sum(counts[lang, s][t] for t in kept)) for t in kept} for s in sources}
        q = {t: share(total[t], sum(total.values())) for t in kept}
        price = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(price(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(price(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(found[:most], 1)}
    return out


def audited(spark, rows, schema=SCHEMA, **options):
    return {tuple(r) for r in divergence.audit(spark.createDataFrame(rows, schema), **options).collect()}


def test_against_plain_python(spark):
    rng, rows = random.Random(5), []
    words = ["wort", "Été", "ÉTÉ", "naïve", "z", "data-set", "x1y", "日本", "a", "B", " gap"]
    for i in range(220):
        source = rng.choice(["s1", "s2", "s3", None, "Ü", "big"])
        text = " ".join(rng.choices(words, [len(source or "") + j for j in range(1, 12)], k=rng.randint(0, 12)))
        rows.append((i, text, rng.choice(["en", "de", None]), source))
    rows += [(None, None, "en", "empty"), (1, "rare words only", "xx", "one"), (1, "rare words only", "xx", "two"), (2, "", "yy", "alone")]
    assert audited(spark, rows, blocks=(3, 32, 1024)) == plain(rows)


def test_several_blocks_of_groups_and_tiles(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices("abcdefghij", k=rng.randint(1, 30))), "en", f"s{i % 7}") for i in range(90)]
    assert audited(spark, rows, blocks=(4, 2, 3)) == plain(rows)


def test_empty_table_ties_and_clashing_columns(spark):
    assert audited(spark, []) == set()
    rows = [(1, "Same words", "en", s, 3, "x", "y") for s in "ab" for _ in range(6)]
    found = audited(spark, rows, SCHEMA + ", n int, term string, value string")
    assert found == plain([r[:4] for r in rows])


@pytest.mark.parametrize("part", [1, 5, 64])
def test_parts_of_long_texts_keep_terms_whole(part):
    body = ("été  ab,c " * 40 + "x" * 200 + " end").encode()
    parts = list(divergence.text_parts(body, part))
    assert b"".join(parts) == body
    assert [t for p in parts for t in divergence.TERM.findall(p)] == divergence.TERM.findall(body)


def test_joint_tables_are_counts_of_terms():
    rng = np.random.default_rng(3)
    level = rng.integers(0, 4, (3, 50))
    g, t = np.nonzero(level)
    block = pd.DataFrame({"lang": "en", "g": g, "term": [f"t{i}" for i in t], "n": level[g, t], "left": 0, "right": 0, "last": 2})
    got = {tuple(r[1:]): r.n for r in divergence.level_products(block)[["lang", "g", "a", "h", "b", "n"]].itertuples(index=False, name="R")}
    want = Counter()
    for i in range(3):
        for j in range(i + 1, 3):
            want.update((i, a, j, b) for a, b, any_ in zip(level[i], level[j], level.any(0)) if any_)
    assert {k[:4]: n for k, n in got.items()} == dict(want)
