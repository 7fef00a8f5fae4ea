"""Discourse, craft, register and family signals against loops over words, written from the definitions and not from the SQL."""

import math
import re
from collections import Counter

import pytest

from inkstone.functions import markers as M
from inkstone.queries import QUERIES

TEXTS = [
    """However, the plan is not simple, but it works. Although critics disagree, we press on. Therefore the council should commit funds. It is important to note that costs rise.

In other words, perhaps it fails. But then it may be fine. It is not a loss. It is a lesson. Not a triumph. The lesson holds, of course. Clearly this is, in some sense, a test of the will. However, for example, like this, because of that, since then, so that we know.""",
    """We argue that this paper shows a result (Smith, 2019). We find that the literature suggests caution (Jones and Brown, 2001). According to the report, research has shown gains.

You said the walk was long. You saw it. You knew it. "I want to go home now and rest," she said. There is a door. There are two windows. What matters is the light. Not only the cat but also the dog sat. Either you go or I stay.""" + " The cat, which was old, sat, and the red dog, the small bird, and the fish looked on." * 8,
    """Get it now! Try it today! You will love your new look, you really will. Boost your day!

Thus it rained. The streets were wet. So people stayed home because of rain. Obviously nobody came. The hall was empty all night long.""",
    "Élan and café but naïve. The éclair is like a cake. One could argue, at the end of the day, that best practices in order to move the needle, in order to win, matter.",
    "",
    None,
    "ø",
]
WORDS = re.compile(r"\w+")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("texts")
    rows = [(i, t, "en", f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def rows(spark, sf, name, *key):
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r for r in QUERIES[name](spark, sf).collect()}


def there(text):
    return bool(text and WORDS.search(text))


def entropy(counts):
    n = sum(counts)
    return -sum(c / n * math.log2(c / n) for c in counts if c) if n else 0.0


def moves_of(text):
    out = []
    for s in re.split(r'(?<=[.!?])\s+(?=[A-Z"“(])', text):
        if s.strip():
            found = [(m.start(), k, c) for k, (c, ps) in enumerate(M.MOVES.items()) for p in ps if (m := re.search(p, s.strip(), re.I))]
            out.append(min(found)[2] if found else "_unmarked")
    return out


def test_moves(spark, sf):
    density, sequence, bigrams = rows(spark, sf, "discourse_moves", "doc_id"), rows(spark, sf, "move_sequence", "doc_id"), rows(spark, sf, "move_bigrams", "move", "next_move")
    pairs = Counter()
    assert set(density) == {i for i, t in enumerate(TEXTS) if there(t)}
    for d, r in density.items():
        t, n = TEXTS[d], len(WORDS.findall(TEXTS[d]))
        for c, ps in M.MOVES.items():
            assert r[c] == pytest.approx(1000 * sum(len(re.findall(p, t, re.I)) for p in ps) / n, abs=1e-3), (d, c)
        own = moves_of(t)
        pairs.update(zip(own, own[1:], strict=False))
        marked = [c for m, c in Counter(own).items() if m != "_unmarked"]
        s = sequence[d]
        assert (s.sentences, s.marked_sentences) == (len(own), sum(marked))
        assert s.entropy == pytest.approx(entropy(Counter(own).values()), abs=1e-4) and s.marked_entropy == pytest.approx(entropy(marked), abs=1e-4)
    assert {k: r.n for k, r in bigrams.items()} == dict(pairs)


def test_relations(spark, sf):
    bucket = {f: b for b, fs in M.RELATION_FORMS.items() for f in fs}
    forms = sorted(bucket, key=len, reverse=True)
    for d, r in rows(spark, sf, "explicit_relations", "doc_id").items():
        found = [" ".join(m.lower().split()) for m in re.findall(r"\b(?:" + "|".join(f.replace(" ", r"\s+") for f in forms) + r")\b", TEXTS[d], re.I)]
        counts = Counter(bucket[f] for f in found)
        assert [r[b] for b in M.RELATION_FORMS] == [counts[b] for b in M.RELATION_FORMS]
        assert r.ambiguous == sum(f in M.AMBIGUOUS_FORMS for f in found) and r.entropy == pytest.approx(entropy(counts.values()), abs=1e-4)


def test_stock_phrases(spark, sf):
    for d, r in rows(spark, sf, "formulaicity", "doc_id").items():
        hits = {g: [len(re.findall(r"\b" + re.escape(p) + r"\b", TEXTS[d], re.I)) for p in ps] for g, ps in M.STOCK_PHRASES.items()}
        assert [r[g] for g in hits] == [sum(h) for h in hits.values()] and r.kinds == sum(x > 0 for h in hits.values() for x in h)
    assert r is not None and rows(spark, sf, "formulaicity", "doc_id")[3].wordy_filler == 2


def sentences(text):
    return [s for s in re.split(r"""(?<=[.!?])\s+(?=[A-Z"'])|\n\n+""", text) if s and s.strip()]


def test_craft_and_constructions(spark, sf):
    craft, built = rows(spark, sf, "craft_patterns", "doc_id"), rows(spark, sf, "constructions", "doc_id")
    for d, r in craft.items():
        own = [s.strip() for s in sentences(TEXTS[d])]
        after = [*own[1:], None]
        correctio = sum(bool(re.search(M.CORRECTIO, s) or (re.search(M.CORRECTIO_FRAME, s) and (re.search(M.CORRECTIO_SAME, s) or (n and re.search(M.CORRECTIO_NEXT, n))))) for s, n in zip(own, after, strict=True))
        hedge = sum(s.startswith("Not ") and len(s.split()) <= 25 and n is not None and not n.startswith("Not ") for s, n in zip(own, after, strict=True))
        assert (r.correctio, r.negation_hedge) == (correctio, hedge)
        for name, pattern in (("triplet", M.TRIPLET), ("pseudo_aphorism", M.APHORISM), ("hedge_and_affirm", M.HEDGE_AND_AFFIRM), ("authority", M.AUTHORITY), ("recommendation", M.RECOMMENDATION), ("false_balance", M.FALSE_BALANCE)):
            assert r[name] == sum(bool(re.search(pattern, s)) for s in own), (d, name)
        b = built[d]
        assert b.existential_there == sum(len(re.findall(M.EXISTENTIAL, s)) for s in own) and b.correlative == sum(len(re.findall(p, s)) for s in own for p in M.CORRELATIVES)
        assert b.pseudo_cleft == sum(len(re.findall(M.PSEUDO_CLEFT, s)) for s in own) and b.concessive_opener == sum(bool(re.match(M.CONCESSIVE_OPENER, s)) for s in own)
    assert craft[0].correctio >= 2 and craft[0].negation_hedge == 1 and craft[1].triplet >= 8 and built[1].existential_there == 2


def test_cadence_and_stacks(spark, tmp_path):
    texts = ["We go on. We go far. We go home. You stay. You stay here. They ran.", "A: b. A: b. X.", "A professor may use it.\n\nA student may ask. More.\n\nThe dean may not.\n\nAn end.", "We go on. We go far. No."]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.doc_id, r["head"], r.first_k, r.n) for r in QUERIES["anaphoric_runs"](spark, str(tmp_path)).collect()]
    assert got == [(0, "we go", 1, 3)]  # two in a row are no run
    assert [(r.doc_id, r.verb, r.n) for r in QUERIES["parallel_stacks"](spark, str(tmp_path)).collect()] == [(2, "may", 3)]


def test_arguments(spark, sf):
    marks = rows(spark, sf, "argument_markers", "doc_id")
    for d, r in marks.items():
        n, count = len(WORDS.findall(TEXTS[d])), lambda p, d=d: len(re.findall(p, TEXTS[d]))
        assert r.discounting_per_1k == pytest.approx(1000 * count(M.DISCOUNTING) / n, abs=1e-3)
        assert r.argument_per_1k == pytest.approx(1000 * (count(M.REASON) + count(M.CONCLUSION)) / n, abs=1e-3)
    stated = lambda markers, t: any(re.search(rf"(?<![a-z]){m}(?![a-z])", t) for m in markers)
    content = lambda t: {w for w in re.findall(r"[a-z0-9']+", t) if w not in M.STOPWORDS}
    got = rows(spark, sf, "enthymeme_gaps", "doc_id")
    for d, t in enumerate(TEXTS):
        steps = gaps = 0
        for para in re.split(r"\n\s*\n", (t or "").strip()):
            own = [s.strip().lower() for s in re.split(r"(?<=[.!?])\s+", para) if s.strip()]
            for k, s in enumerate(own):
                if stated(M.CONCLUSION_MARKERS, s) or (k == len(own) - 1 and k):
                    steps += 1
                    before = " ".join(own[max(0, k - 3) : k])
                    a, b = content(s), content(before)
                    gaps += not stated(M.WARRANT_MARKERS, f"{before} {s}") and (not a | b or len(a & b) / len(a | b) < 0.6)
        assert (got[d].steps, got[d].gaps) == (steps, gaps) if steps else d not in got


def test_registers(spark, sf):
    scores, told = rows(spark, sf, "register_scores", "doc_id", "register"), rows(spark, sf, "register_classifier", "doc_id")
    soft = lambda v, x, less: (1.0 if v <= 0 else max(0.0, 1 - v / x)) if less else min(1.0, max(0.0, v / x))
    for d, t in enumerate(TEXTS):
        if not there(t):
            assert d not in told
            continue
        n = len(WORDS.findall(t))
        if n < 100:
            assert (told[d].primary_register, told[d].refusal) == ("unknown", "short_text")
            continue
        f = {k: 1000 * len(re.findall(p, t)) / n for k, p in M.REGISTER_FEATURES.items()}
        f["dialogue_ratio"] = sum(len(WORDS.findall(q)) for q in re.findall(r'["“][^"”\n]{1,200}["”]', t)) / n
        paragraphs = [p for p in re.split(r"\n\s*\n", t) if p.strip()]
        f["mean_paragraph_words"] = sum(len(WORDS.findall(p)) for p in paragraphs) / len(paragraphs)
        want = {r: round(sum(soft(f[k], x, less) for k, x, less in xs) / len(xs), 4) for r, xs in M.REGISTERS.items()}
        assert {r: scores[d, r].score for r in want} == pytest.approx(want, abs=2e-4)
        best = max(want.values())
        assert told[d].confidence == pytest.approx(best, abs=2e-4) and told[d].primary_register == (max(want, key=want.get) if best >= 0.3 else "unknown")


def test_predicates_by_hand(spark, tmp_path):
    texts = ["é" * 4 + "a" * 100, "é" * 5 + "a" * 995, "é" * 5 + "a" * 996, "— … “ ” ’ –" * 9, "the of it. And the. Cat of a the"]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.switched for r in QUERIES["code_switching"](spark, str(tmp_path)).collect()} == {0: False, 1: True, 2: False, 3: False, 4: False}
    # a sentence end breaks a run: "the of it", "and the", then "of a the" after a content word
    assert [(r.doc_id, r.runs, r.longest, r.words) for r in QUERIES["function_word_runs"](spark, str(tmp_path)).collect() if r.doc_id == 4] == [(4, 3, 3, 8)]


def test_families_against_a_loop(spark, sf):
    """Delta of the punctuation family: each source against the others."""
    table = {r.source: r.asDict() for r in QUERIES["punctuation_family"](spark, sf).collect()}
    names = [k for k in next(iter(table.values())) if k != "source"]
    got = {(r.source, r.family): r for r in QUERIES["family_distances"](spark, sf).collect()}
    for s, own in table.items():
        z = []
        for n in names:
            base = [x[n] for t, x in table.items() if t != s]
            mean = sum(base) / len(base)
            var = sum((b - mean) ** 2 for b in base) / (len(base) - 1)
            if var > 1e-9 * mean * mean:
                z.append(abs(own[n] - mean) / math.sqrt(var))
        assert got[s, "punctuation"].delta == pytest.approx(sum(z) / len(z), rel=1e-3)
