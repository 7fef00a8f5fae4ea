"""Marker-based signals of discourse: moves, relations, stock phrases, craft patterns, constructions, arguments, register.

Every count is local to a document or a sentence. Markers are read in texts whose letters beyond ASCII are underscores, so
that both engines see the same word ends. Texts without words have no row.
"""

from re import _constants as sre
from re._parser import parse as sre_parse

from inkstone.functions import markers as M
from inkstone.functions.moves import FOUND
from inkstone.functions.text import MARK
from inkstone.plans.catalogue import query, relation

relation("folded", f"SELECT doc_id, text, @SUB(text;;{M.BEYOND_ASCII};;_)@ AS t FROM {{documents}} WHERE text IS NOT NULL")
relation("word_sized", "SELECT doc_id, text, t, @COUNT(t;;\\w+)@ AS n_words FROM {folded} WHERE @MATCH(t;;\\w)@")


def _any(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _per_1k(count: str, digits: int = 4) -> str:
    return f"round(CAST(1000 * ({count}) AS DOUBLE) / n_words, {digits})"


def _letters(parsed) -> set[str]:
    """Letters, lowered, with which a match of a parsed pattern may begin."""
    for kind, value in parsed:
        if kind is sre.AT:
            continue
        if kind is sre.SUBPATTERN:
            return _letters(value[-1])
        if kind is sre.BRANCH:
            return set().union(*map(_letters, value[1]))
        if kind is sre.IN and all(k is sre.LITERAL for k, _ in value):
            return {chr(c).lower() for _, c in value}
        if kind is sre.LITERAL:
            return {chr(value).lower()}
        break
    raise ValueError(f"no letter to begin with: {parsed}")


def _led(pattern: str) -> str:
    """A pattern behind a look at one letter, which is cheap where no match begins; for patterns that hold for any case."""
    return f"(?=[{''.join(sorted(_letters(sre_parse(pattern))))}]){pattern}"


# moves
_DENSITIES = ",\n  ".join(f"1000.0 * ({' + '.join(f'@COUNT(t;;(?i){p})@' for p in ps)}) / n_words AS {c}" for c, ps in M.MOVES.items())
relation("move_densities", f"SELECT doc_id, n_words,\n  {_DENSITIES}\nFROM {{word_sized}}", spark=f"SELECT doc_id, n_words, {', '.join(f'1000.0 * d_{c} / n_words AS {c}' for c in M.MOVES)} FROM {{move_counts}}")
query("discourse_moves", f"SELECT doc_id, n_words, {', '.join(f'round({c}, 4) AS {c}' for c in M.MOVES)}, round({' + '.join(M.MOVES)}, 4) AS total FROM {{move_densities}}")
_EVERY = _any(p for ps in M.MOVES.values() for p in ps)
_FIRST = "CASE " + " ".join(f"WHEN @MATCH(tail;;^(?i)(?:{_any(ps)}))@ THEN '{c}'" for c, ps in M.MOVES.items()) + " END"
relation("move_parts", f"""SELECT doc_id, @PARTS(@SUB(t;;([.!?])\\s+([A-Z"“(]);;$1{MARK}$2)@;;{MARK})@ AS parts FROM {{word_sized}}""")
relation("move_sents", "SELECT doc_id, @NUMBERED(parts;;k;;sent)@ FROM {move_parts}")
# a sentence's move: what stands before its first marker is cut off, and the first move whose markers begin what is left counts
relation("moves", f"""
WITH s AS (SELECT doc_id, k, trim(sent) AS sent FROM {{move_sents}} WHERE @MATCH(sent;;\\S)@),
f AS (SELECT doc_id, k, CASE WHEN @MATCH(sent;;(?i){_EVERY})@ THEN substr(sent, length(@GROUP(sent;;(?is)^(.*?)(?:{_EVERY}))@) + 1) END AS tail FROM s)
SELECT doc_id, k, coalesce({_FIRST}, '_unmarked') AS move FROM f""", spark=f"""
WITH s AS (SELECT doc_id, k, trim(sent) AS sent FROM {{move_sents}} WHERE @MATCH(sent;;\\S)@),
f AS (SELECT doc_id, k, nullif(@FIRST(sent;;(?is)(?=[a-z])\\b(?:{_any(_led(p) for ps in M.MOVES.values() for p in ps)}).*)@, '') AS tail FROM s)
SELECT doc_id, k, coalesce({_FIRST}, '_unmarked') AS move FROM f""")
query("move_bigrams", """
WITH b AS (SELECT doc_id, move, lead(move) OVER (PARTITION BY doc_id ORDER BY k) AS next_move FROM {moves})
SELECT move, next_move, count(*) AS n, count(DISTINCT doc_id) AS docs FROM b WHERE next_move IS NOT NULL GROUP BY move, next_move""")
_SEQUENCE = """f AS (SELECT e.doc_id, n, m, entropy, marked, CASE WHEN contrast + concession + consequence + elaboration + exemplification + sequencing + reframing + epistemic_stance + boosting + hedging + self_correction + metadiscourse >= 30 THEN 1 ELSE 0 END AS dense,
  CASE WHEN round(marked, 9) <= 1.5 AND m >= 3 THEN 1 ELSE 0 END AS narrow, CASE WHEN concession >= 5 AND contrast >= 5 AND consequence >= 3 THEN 1 ELSE 0 END AS triad, CASE WHEN metadiscourse >= 3 THEN 1 ELSE 0 END AS meta, CASE WHEN hedging > 4 AND boosting > 4 THEN 1 ELSE 0 END AS swing FROM e JOIN {move_densities} d ON d.doc_id = e.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS sentences, CAST(m AS BIGINT) AS marked_sentences, round(entropy + 0.0, 5) AS entropy, round(marked + 0.0, 5) AS marked_entropy, dense, narrow, triad, meta, swing,
  CASE WHEN dense + narrow + triad + meta + swing < 1 THEN 'light' WHEN dense + narrow + triad + meta + swing < 3 THEN 'moderate' ELSE 'heavy' END AS band FROM f"""
_share = lambda c, n: f"CASE WHEN {c} > 0 THEN {c} / {n} * log2({c} / {n}) ELSE 0 END"
# on Spark a text's sentences are counted by move where it lies
query("move_sequence", """
WITH c AS (SELECT doc_id, move, count(*) AS c FROM {moves} GROUP BY doc_id, move),
n AS (SELECT doc_id, sum(c) AS n, sum(CASE WHEN move <> '_unmarked' THEN c ELSE 0 END) AS m FROM c GROUP BY doc_id),
e AS (SELECT c.doc_id, max(n.n) AS n, max(n.m) AS m, 0.0 - sum(c.c / n.n * log2(c.c / n.n)) AS entropy, 0.0 - sum(CASE WHEN move <> '_unmarked' THEN c.c / n.m * log2(c.c / n.m) ELSE 0 END) AS marked FROM c JOIN n ON n.doc_id = c.doc_id GROUP BY c.doc_id),
""" + _SEQUENCE, spark=f"""
WITH c AS (SELECT *, {' + '.join(f'c_{m}' for m in M.MOVES)} AS m, {' + '.join(f'c_{m}' for m in FOUND)} AS n FROM {{move_counts}}),
e AS (SELECT doc_id, n, m, 0.0 - ({' + '.join(_share(f'c_{x}', 'n') for x in FOUND)}) AS entropy, 0.0 - ({' + '.join(_share(f'c_{x}', 'm') for x in M.MOVES)}) AS marked, {', '.join(f'1000.0 * d_{x} / n_words AS {x}' for x in M.MOVES)} FROM c),
""" + _SEQUENCE.replace("FROM e JOIN {move_densities} d ON d.doc_id = e.doc_id", "FROM e"))

# explicit relations: one pass over all forms, longest first
_FORMS = sorted((f for fs in M.RELATION_FORMS.values() for f in fs), key=lambda f: (-len(f), f))
_COMBINED = r"(?i)\b(?:" + "|".join(f.replace(" ", r"\s+") for f in _FORMS) + r")\b"
_member = lambda forms: "^(?:" + "|".join(f.replace(" ", r"\s+") for f in forms) + ")$"
_RELS = ", ".join(f"@COUNTIN(hits;;(?i){_member(fs)})@ AS {b}" for b, fs in M.RELATION_FORMS.items())
query("explicit_relations", f"""
WITH h AS (SELECT doc_id, n_words, @ALL(t;;{_COMBINED})@ AS hits FROM {{word_sized}}),
c AS (SELECT doc_id, n_words, {_RELS}, @COUNTIN(hits;;(?i){_member(M.AMBIGUOUS_FORMS)})@ AS ambiguous FROM h),
s AS (SELECT *, comparison + contingency + expansion + temporal AS n FROM c)
SELECT doc_id, comparison, contingency, expansion, temporal, ambiguous, {_per_1k('n')} AS per_1k,
  round(0.0 - ({' + '.join(f'CASE WHEN {b} > 0 THEN {b} * 1.0 / n * log2({b} * 1.0 / n) ELSE 0 END' for b in M.RELATION_FORMS)}) + 0.0, 5) AS entropy FROM s""")

# stock phrases: each phrase is counted by itself, as phrases may overlap
_phrase = lambda p: r"(?i)\b" + p.replace("-", r"\-") + r"\b"
_GROUPS = {g: " + ".join(f"@COUNT(t;;{_phrase(p)})@" for p in ps) for g, ps in M.STOCK_PHRASES.items()}
_DISTINCT = " + ".join(f"CASE WHEN @MATCH(t;;{_phrase(p)})@ THEN 1 ELSE 0 END" for ps in M.STOCK_PHRASES.values() for p in ps)
query("formulaicity", f"""
WITH c AS (SELECT doc_id, @COUNT(t;;\\b\\w[\\w'-]*\\b)@ AS n_words, {', '.join(f'{e} AS {g}' for g, e in _GROUPS.items())}, {_DISTINCT} AS kinds FROM {{word_sized}})
SELECT doc_id, {', '.join(_GROUPS)}, kinds, {_per_1k(' + '.join(_GROUPS), 2).replace("n_words", "nullif(n_words, 0)")} AS per_1k FROM c""")

# craft patterns of sentences: a sentence counts once per pattern
relation("craft_sents", f"SELECT doc_id, snum, trim(@SUB(sent;;{M.BEYOND_ASCII};;_)@) AS s FROM {{sents}}")
relation("craft_hits", f"""
WITH p AS (SELECT doc_id, snum, s, lead(s) OVER (PARTITION BY doc_id ORDER BY snum) AS nxt FROM {{craft_sents}})
SELECT doc_id, count_if(@MATCH(s;;{M.CORRECTIO})@ OR (@MATCH(s;;{M.CORRECTIO_FRAME})@ AND (@MATCH(s;;{M.CORRECTIO_SAME})@ OR coalesce(@MATCH(nxt;;{M.CORRECTIO_NEXT})@, false)))) AS correctio,
  count_if(@MATCH(s;;^Not )@ AND @COUNT(s;;\\S+)@ <= 25 AND nxt IS NOT NULL AND NOT @MATCH(nxt;;^Not )@) AS negation_hedge,
  count_if(@MATCH(s;;{M.APHORISM})@) AS pseudo_aphorism, count_if(@MATCH(s;;{M.TRIPLET})@) AS triplet, count_if(@MATCH(s;;{M.FALSE_BALANCE})@) AS false_balance,
  count_if(@MATCH(s;;{M.HEDGE_AND_AFFIRM})@) AS hedge_and_affirm, count_if(@MATCH(s;;{M.RECOMMENDATION})@) AS recommendation, count_if(@MATCH(s;;{M.AUTHORITY})@) AS authority FROM p GROUP BY doc_id""")
_CRAFT = ("correctio", "negation_hedge", "pseudo_aphorism", "triplet", "false_balance", "hedge_and_affirm", "recommendation", "authority")
query("craft_patterns", f"SELECT h.doc_id, {', '.join(f'{c}, {_per_1k(c)} AS {c}_per_1k' for c in _CRAFT)} FROM {{craft_hits}} h JOIN {{word_sized}} w ON w.doc_id = h.doc_id")
# three sentences or more in a row that open with the same two words (marks left out)
relation("cadence_runs", """
WITH h AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY snum) AS k, @SUB(lower(@FIRST(s;;^\\S+(\\s+\\S+)?)@);;[^\\w\\s];;)@ AS head FROM {craft_sents}),
b AS (SELECT doc_id, k, @SUB(head;;\\s+;; )@ AS head FROM h),
r AS (SELECT doc_id, k, head, k - row_number() OVER (PARTITION BY doc_id, head ORDER BY k) AS run FROM b WHERE length(head) >= 2)
SELECT doc_id, head, run, min(k) AS first_k, count(*) AS n FROM r GROUP BY doc_id, head, run HAVING count(*) >= 3""")
query("anaphoric_runs", "SELECT doc_id, head, first_k, n FROM {cadence_runs}")
# three paragraphs or more in a row whose second opening word (after a determiner) is the same
relation("paragraph_parts", f"SELECT doc_id, @PARTS(@SUB(text;;\\n\\s*\\n;;{MARK})@;;{MARK})@ AS parts FROM {{documents}} WHERE text IS NOT NULL")
relation("paragraphs", "SELECT doc_id, k, para FROM (SELECT doc_id, @NUMBERED(parts;;k;;para)@ FROM {paragraph_parts}) x WHERE @MATCH(para;;\\S)@")
query("parallel_stacks", f"""
WITH p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS k, lower(trim(@SUB(@SUB(para;;{M.BEYOND_ASCII};;_)@;;\\s+;; )@)) AS t FROM {{paragraphs}}),
o AS (SELECT doc_id, k, @SUB(@FIRST(@SUB(t;;[.!?] .*;;)@;;^\\S+( \\S+)?( \\S+)?)@;;^(a|an|the|these|those|my|our|their|his|her) ;;)@ AS head FROM p),
m AS (SELECT doc_id, k, @GROUP(@SUB(head;;[^\\w\\s];;)@;;^\\s*\\S+ (\\S+))@ AS verb FROM o),
r AS (SELECT doc_id, k, verb, k - row_number() OVER (PARTITION BY doc_id, verb ORDER BY k) AS run FROM m WHERE verb NOT IN ('', 'the', 'a', 'an'))
SELECT doc_id, verb, min(k) AS first_k, count(*) AS n FROM r GROUP BY doc_id, verb, run HAVING count(*) >= 3""")

# constructions that need no parser
_COUNTED = {"pseudo_cleft": (M.PSEUDO_CLEFT,), "existential_there": (M.EXISTENTIAL,), "correlative": M.CORRELATIVES, "parenthetical_insertion": (M.PARENTHETICAL,)}
query("constructions", f"""
WITH s AS (SELECT doc_id, snum, s, @GROUP(s;;{M.FRONTED_ADVERBIAL})@ AS front, substr(s, 1, 30) AS opening FROM {{craft_sents}} WHERE NOT @MATCH(s;;^\\s*>)@),
c AS (SELECT doc_id, {', '.join(f"sum({' + '.join(f'@COUNT(s;;{p})@' for p in ps)}) AS {c}" for c, ps in _COUNTED.items())},
  count_if(@MATCH(s;;{M.CONCESSIVE_OPENER})@) AS concessive_opener, count_if(@MATCH(s;;{M.PARTICIPIAL_OPENER})@) AS participial_opener,
  count_if(NOT @MATCH(s;;{M.PARTICIPIAL_OPENER})@ AND NOT @MATCH(s;;{M.CONCESSIVE_OPENER})@ AND NOT @MATCH(opening;;["'])@ AND @COUNT(front;;\\S+)@ BETWEEN 2 AND 8) AS fronted_adverbial FROM s GROUP BY doc_id)
SELECT c.doc_id, {', '.join(f'CAST({c} AS BIGINT) AS {c}, {_per_1k(c)} AS {c}_per_1k' for c in [*_COUNTED, 'concessive_opener', 'participial_opener', 'fronted_adverbial'])} FROM c JOIN {{word_sized}} w ON w.doc_id = c.doc_id""")

# argument markers
query("argument_markers", f"""
WITH c AS (SELECT doc_id, n_words, @COUNT(t;;{M.DISCOUNTING})@ AS discounting, @COUNT(t;;{M.REASON})@ AS reason, @COUNT(t;;{M.CONCLUSION})@ AS conclusion, @COUNT(t;;{M.ABUSIVE_ASSURING})@ AS assuring FROM {{word_sized}})
SELECT doc_id, {_per_1k('discounting')} AS discounting_per_1k, {_per_1k('reason + conclusion')} AS argument_per_1k, CASE WHEN conclusion > 0 THEN round(reason * 1.0 / conclusion, 3) ELSE CAST(reason AS DOUBLE) END AS reason_to_conclusion, {_per_1k('assuring')} AS assuring_per_1k FROM c""")

# enthymemes: a marked or paragraph-final conclusion, no stated warrant in it and up to three sentences before, other content than theirs
_concl = r"(^|[^a-z])(?:" + "|".join(M.CONCLUSION_MARKERS) + r")($|[^a-z])"
_warrant = r"(^|[^a-z])(?:" + "|".join(M.WARRANT_MARKERS) + r")($|[^a-z])"
relation("argument_parts", f"SELECT doc_id, k AS para, @PARTS(@SUB(trim(para);;([.!?])\\s+;;$1{MARK})@;;{MARK})@ AS parts FROM {{paragraphs}}")
relation("argument_sents", "SELECT doc_id, para, k, lower(sent) AS s FROM (SELECT doc_id, para, @NUMBERED(parts;;k;;sent)@ FROM {argument_parts}) x WHERE @MATCH(sent;;\\S)@")
relation("argument_steps", f"""
WITH w AS (SELECT doc_id, para, k, s, lead(k) OVER o IS NULL AS terminal, lag(s) OVER o AS b1, lag(s, 2) OVER o AS b2, lag(s, 3) OVER o AS b3 FROM {{argument_sents}} WINDOW o AS (PARTITION BY doc_id, para ORDER BY k)),
m AS (SELECT *, @MATCH(s;;{_concl})@ AS marked, concat_ws(' ', b3, b2, b1) AS grounds FROM w)
SELECT doc_id, para, k, marked, @MATCH(concat_ws(' ', grounds, s);;{_warrant})@ AS warranted,
  @DISTINCT(@ALL(@SUB(concat(' ', @SUB(s;;[^a-z0-9']+;;  )@, ' ');; (?:{'|'.join(M.STOPWORDS)}) ;; )@;;[a-z0-9']+)@)@ AS own,
  @DISTINCT(@ALL(@SUB(concat(' ', @SUB(grounds;;[^a-z0-9']+;;  )@, ' ');; (?:{'|'.join(M.STOPWORDS)}) ;; )@;;[a-z0-9']+)@)@ AS before FROM m WHERE marked OR (terminal AND b1 IS NOT NULL)""")
query("enthymeme_gaps", """
WITH o AS (SELECT doc_id, para, k, marked, warranted, @SHARED(own;;before)@ AS common, @SIZE(own)@ AS n1, @SIZE(before)@ AS n2 FROM {argument_steps}),
f AS (SELECT doc_id, marked, warranted, NOT warranted AND (n1 + n2 - common = 0 OR common * 10 < 6 * (n1 + n2 - common)) AS flagged FROM o)
SELECT doc_id, count(*) AS steps, count_if(marked) AS conclusions, count_if(warranted) AS warrants, count_if(flagged) AS gaps, round(count_if(flagged) * 1.0 / count(*), 6) AS density,
  CASE WHEN count_if(flagged) * 1.0 / count(*) < 0.15 THEN 'sparse' WHEN count_if(flagged) * 1.0 / count(*) <= 0.65 THEN 'typical' ELSE 'dense' END AS band FROM f GROUP BY doc_id""")

# registers
_soft = lambda f, x, less: f"(CASE WHEN {f} <= 0 THEN 1.0 ELSE greatest(0.0, 1.0 - {f} / {x}) END)" if less else f"least(1.0, greatest(0.0, {f} / {x}))"
_DIALOGUE = r"""["“][^"”\n]{1,200}["”]"""
relation("register_features", f"""
WITH q AS (SELECT doc_id, t, n_words, concat_ws(' ', @ALL(t;;{_DIALOGUE})@) AS said FROM {{word_sized}}),
p AS (SELECT doc_id, count(*) AS n_paragraphs FROM {{paragraphs}} GROUP BY doc_id)
SELECT q.doc_id, n_words, {', '.join(f'1000.0 * @COUNT(t;;{p})@ / n_words AS {f}' for f, p in M.REGISTER_FEATURES.items())}, @COUNT(said;;\\w+)@ * 1.0 / n_words AS dialogue_ratio, n_words * 1.0 / n_paragraphs AS mean_paragraph_words FROM q JOIN p ON p.doc_id = q.doc_id""".replace("concat_ws(' ', @ALL", "@JOINED(@ALL").replace(")@) AS said", ")@)@ AS said"))
_SCORES = {r: f"round(({' + '.join(_soft(*x) for x in xs)}) / {len(xs)}.0, 4)" for r, xs in M.REGISTERS.items()}
relation("register_scores", " UNION ALL ".join(f"SELECT doc_id, '{r}' AS register, {e} AS score FROM {{register_features}} WHERE n_words >= 100" for r, e in _SCORES.items()),
    spark=f"SELECT doc_id, stack({len(_SCORES)}, {', '.join(f"'{r}', {e}" for r, e in _SCORES.items())}) AS (register, score) FROM {{register_features}} WHERE n_words >= 100")
query("register_scores", "SELECT doc_id, register, score FROM {register_scores}")
query("register_classifier", """
WITH b AS (SELECT doc_id, register, score, max(score) OVER (PARTITION BY doc_id) AS best FROM {register_scores}),
t AS (SELECT doc_id, max(best) AS best, count_if(score = best) AS ties, min(CASE WHEN score = best THEN register END) AS top, count_if(best - score < 0.1 AND score > 0.3) AS near FROM b GROUP BY doc_id)
SELECT w.doc_id, CASE WHEN t.doc_id IS NULL OR best < 0.3 OR ties > 1 THEN 'unknown' ELSE top END AS primary_register, coalesce(best, 0.0) AS confidence, CASE WHEN t.doc_id IS NULL THEN 'short_text' WHEN best < 0.3 THEN 'all_weak' WHEN ties > 1 THEN 'exact_top_tie' END AS refusal, near
FROM {word_sized} w LEFT JOIN t ON t.doc_id = w.doc_id""")
