"""Per-document lexical, rhythmic and structural signals, and the compression verdict."""

from inkstone.plans.catalogue import query, relation

query("tokens_per_doc", "SELECT doc_id, count(*) AS n_tokens, count(DISTINCT word) AS n_types FROM {tokens} GROUP BY doc_id")
query("unicode_tokens_per_doc", "SELECT doc_id, count(*) AS n_tokens FROM {wide_tokens} GROUP BY doc_id")
query("sentence_count", "SELECT doc_id, count(*) AS n_sentences FROM {sents} GROUP BY doc_id")
query("paragraph_split", "SELECT doc_id, @COUNT(text;;\\S[^\\n]*\\n\\s*\\n)@ + 1 AS n_breaks FROM {documents}")
query("sentence_positions", """
SELECT doc_id, snum, length(sent) AS n_chars, snum = min(snum) OVER (PARTITION BY doc_id) AS is_first, snum = max(snum) OVER (PARTITION BY doc_id) AS is_last
FROM {sents}""")
query("char_trigrams_top", """
WITH c AS (SELECT lang, gram, count(*) AS n FROM {trigrams} GROUP BY lang, gram),
r AS (SELECT lang, gram, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS k FROM c)
SELECT lang, gram, n, k FROM r WHERE k <= 50""", spark="""
SELECT lang, gram, n, k FROM (SELECT lang, gram, c AS n, row_number() OVER (PARTITION BY lang ORDER BY c DESC, gram) AS k FROM {trigram_counts}) r WHERE k <= 50""")
query("token_windows", """
WITH n AS (SELECT doc_id, count(*) AS n FROM {tokens} GROUP BY doc_id),
w AS (SELECT t.doc_id, CAST(floor(t.pos / 100) AS BIGINT) AS win, t.word FROM {tokens} t JOIN n ON n.doc_id = t.doc_id WHERE n.n >= 100)
SELECT doc_id, win, count(*) AS n_tokens, round(count(DISTINCT word) / count(*), 6) AS ttr FROM w GROUP BY doc_id, win""")
# windows of 100 words every 50, and the last 100 of a text; a shorter text is one window
query("overlapping_windows", """
WITH n AS (SELECT doc_id, CAST(n AS BIGINT) AS n FROM {doc_totals}),
w AS (SELECT doc_id, n, @UNNEST(CAST(0 AS BIGINT);;greatest(CAST(floor((n - 100) / 50.0) AS BIGINT), CAST(0 AS BIGINT)))@ AS k FROM n),
t AS (SELECT doc_id, n, k * 50 AS a FROM w UNION SELECT doc_id, n, greatest(n - 100, 0) FROM n),
r AS (SELECT t.doc_id, t.a, least(t.a + 100, t.n) AS z, t.n FROM t)
SELECT r.doc_id, r.a AS start_word, r.z AS end_word, r.z = r.n AS pinned FROM r""")
# deterministic places for slices of 50 words: eight a text, by a hash of text and number; shorter texts have none
query("length_matched_slices", """
WITH n AS (SELECT doc_id, CAST(n AS BIGINT) AS n FROM {doc_totals} WHERE n >= 50), k AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS v(i))
SELECT doc_id, i, CAST((@MOD32(concat('slice:', CAST(doc_id AS STRING), ':', CAST(i AS STRING));;4294967296)@) % (n - 49) AS BIGINT) AS start_word FROM n CROSS JOIN k""")
# chapters begin at heading lines; what stands before the first one is chapter 0
query("chapter_split", """
WITH m AS (SELECT doc_id, lnum, line, CASE WHEN @MATCH(line;;^(#+ |(?i:chapter|part) [0-9IVXLC]+))@ THEN 1 ELSE 0 END AS marks FROM {lines}),
c AS (SELECT doc_id, lnum, line, sum(marks) OVER (PARTITION BY doc_id ORDER BY lnum) AS chapter FROM m)
SELECT doc_id, CAST(chapter AS BIGINT) AS chapter, min(lnum) AS first_line, count(*) AS n_lines, CAST(sum(@COUNT(lower(line);;[a-z']+)@) AS BIGINT) AS n_words FROM c GROUP BY doc_id, chapter""")
query("sentence_windows", """
WITH s AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY snum) - 1 AS k FROM {sent_words}),
f AS (SELECT doc_id, k, sum(w) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS words, count(*) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS n FROM s)
SELECT doc_id, k AS first_sentence, CAST(words AS BIGINT) AS words FROM f WHERE n = 5 AND k % 2 = 0""")
query("prompt_window_placement", """
WITH n AS (SELECT doc_id, CAST(n AS BIGINT) AS n FROM {doc_totals}),
k AS (SELECT * FROM (VALUES (0), (1), (2), (3)) AS v(i))
SELECT doc_id, i, CAST(floor((n - 60) * i / 3.0) AS BIGINT) AS start_word, CAST(floor((n - 60) * i / 3.0) AS BIGINT) + 60 AS end_word FROM n CROSS JOIN k WHERE n >= 120""")
query("prompt_window_overlaps", """
WITH n AS (SELECT doc_id, CAST(n AS BIGINT) AS n FROM {doc_totals}),
k AS (SELECT * FROM (VALUES (0), (1), (2), (3)) AS v(i)),
w AS (SELECT doc_id, i, CAST(floor((n - 60) * i / 3.0) AS BIGINT) AS a FROM n CROSS JOIN k WHERE n >= 120)
SELECT x.doc_id, x.i AS i, y.i AS j, least(x.a, y.a) + 60 - greatest(x.a, y.a) AS shared FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.i < y.i AND x.a < y.a + 60 AND y.a < x.a + 60""")
query("passages", """
SELECT doc_id, lnum AS ordinal, concat(CAST(doc_id AS STRING), '#p', lpad(CAST(lnum AS STRING), 4, '0')) AS passage_id,
  CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY lnum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start, length(line) AS n_chars
FROM {lines}""")
# runs of two function words or more; a content word ends a run, and so does a sentence
relation("sent_tokens", "SELECT doc_id, snum, @NUMBERED(ws;;k;;word)@ FROM (SELECT doc_id, snum, @ALL(lower(sent);;[a-z']+)@ AS ws FROM {sents}) x")
query("function_word_runs", """
WITH t AS (SELECT t.doc_id, t.snum, t.k, CASE WHEN f.word IS NULL THEN 1 ELSE 0 END AS content FROM {sent_tokens} t LEFT JOIN {function_words} f ON f.word = t.word),
g AS (SELECT doc_id, snum, content, sum(content) OVER (PARTITION BY doc_id, snum ORDER BY k) AS island FROM t),
r AS (SELECT doc_id, snum, island, count(*) AS n FROM g WHERE content = 0 GROUP BY doc_id, snum, island)
SELECT doc_id, count(*) AS runs, max(n) AS longest, CAST(sum(n) AS BIGINT) AS words FROM r WHERE n >= 2 GROUP BY doc_id""")

# quoted spans, and who said them by a tag after ("..." said Ann) or before (Ann said, "..."); tags are a few verbs
relation("quote_parts", """
SELECT doc_id, @ALL(text;;([A-Z][a-z]+ (?:said|asked|replied|cried|answered|whispered),? )?["“][^"”\\n]+["”](?:,? (?:said|asked|replied|cried|answered|whispered) [A-Z][a-z]+|,? [A-Z][a-z]+ (?:said|asked|replied|cried|answered|whispered))?)@ AS turns FROM {documents} WHERE text IS NOT NULL""")
query("dialogue_turns", """
WITH t AS (SELECT doc_id, @NUMBERED(turns;;k;;turn)@ FROM {quote_parts}),
s AS (SELECT doc_id, k, turn, @COUNT(lower(@FIRST(turn;;["“][^"”]+["”])@);;[a-z']+)@ AS words, @GROUP(turn;;^([A-Z][a-z]+) )@ AS before, @GROUP(turn;;["”],? (?:[a-z]+ )?([A-Z][a-z]+)(?: [a-z]+)?$)@ AS after FROM t)
SELECT doc_id, k, words, CASE WHEN after <> '' THEN after WHEN before <> '' THEN before END AS speaker FROM s""")

relation("sentence_stats", """
SELECT doc_id, count(*) AS n, avg(w) AS mean, coalesce(stddev_samp(w), 0) AS sd, coalesce(var_samp(w), 0) AS variance, min(w) AS least, max(w) AS most FROM {sent_words} WHERE w > 0 GROUP BY doc_id""",
    spark="SELECT doc_id, s_n AS n, s_mean AS mean, coalesce(sqrt(s_var), 0) AS sd, coalesce(s_var, 0) AS variance, s_min AS least, s_max AS most FROM {measures} WHERE s_n > 0")
query("sentence_length_stats", """
SELECT doc_id, n AS n_sentences, round(mean, 6) AS mean, round(sd, 6) AS sd, round(variance, 6) AS variance, least AS min_words, most AS max_words, round((sd - mean) / nullif(sd + mean, 0), 6) AS burstiness_b FROM {sentence_stats}""")

relation("mattr", """
WITH p AS (SELECT doc_id, pos, coalesce(lag(pos) OVER (PARTITION BY doc_id, word ORDER BY pos), -1) AS prev FROM {tokens}),
q AS (SELECT p.doc_id, n, least(pos, n - 50) - greatest(prev + 1, pos - 49, 0) + 1 AS starts, prev FROM p JOIN {doc_totals} d ON d.doc_id = p.doc_id)
SELECT doc_id, max(n) AS n, CASE WHEN max(n) >= 50 THEN sum(CASE WHEN starts > 0 THEN starts ELSE 0 END) / (50.0 * (max(n) - 49)) ELSE sum(CASE WHEN prev < 0 THEN 1 ELSE 0 END) * 1.0 / max(n) END AS mattr FROM q GROUP BY doc_id""", spark="SELECT doc_id, n, mattr FROM {measures} WHERE n > 0")
query("mattr50", "SELECT doc_id, round(CAST(mattr AS DOUBLE), 6) AS mattr FROM {mattr}")
relation("yule", "SELECT doc_id, sum(c) AS n, 10000.0 * (sum(c * c) - sum(c)) / (sum(c) * sum(c)) AS k FROM {doc_words} GROUP BY doc_id", spark="SELECT doc_id, n, 10000.0 * (squares - n) / (n * n) AS k FROM {measures} WHERE n > 0")
query("yules_k", "SELECT doc_id, CAST(n AS BIGINT) AS n_tokens, round(CAST(k AS DOUBLE), 6) AS yules_k FROM {yule}")
relation("entropy", "SELECT w.doc_id, 0.0 - sum(c / n * log2(c / n)) AS bits FROM {doc_words} w JOIN {doc_totals} d ON d.doc_id = w.doc_id GROUP BY w.doc_id", spark="SELECT doc_id, bits FROM {measures} WHERE n > 0")
query("shannon_entropy", "SELECT doc_id, round(bits + 0.0, 6) AS bits FROM {entropy}")
query("syllables_per_word", """
SELECT doc_id, round(avg(CAST(greatest(1, @COUNT(word;;[aeiouy]+)@ - CASE WHEN @MATCH(word;;e$)@ AND @COUNT(word;;[aeiouy]+)@ > 1 THEN 1 ELSE 0 END) AS DOUBLE)), 6) AS syllables FROM {tokens} GROUP BY doc_id""")
# a word has as many syllables as vowel groups, less a final e that is one of several, but one at least
relation("fkgl_stats", """
WITH s AS (SELECT doc_id, snum, regexp_extract_all(lower(sent), '[a-z'']+') AS ws FROM {sents}),
x AS (SELECT doc_id, snum, len(ws) AS w, list_sum(list_transform(ws, lambda v: greatest(1, len(regexp_extract_all(v, '[aeiouy]+')) - CASE WHEN right(v, 1) = 'e' AND len(regexp_extract_all(v, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))) AS s FROM s),
g AS (SELECT doc_id, 0.39 * w + 11.8 * s / w - 15.59 AS grade FROM x WHERE w > 0)
SELECT doc_id, avg(grade) AS mean, stddev_samp(grade) AS sd, min(grade) AS least, max(grade) AS most FROM g GROUP BY doc_id""",
    spark="SELECT doc_id, g_mean AS mean, sqrt(g_var) AS sd, g_min AS least, g_max AS most FROM {measures} WHERE s_n > 0")
query("fkgl_stats", "SELECT doc_id, round(CAST(mean AS DOUBLE), 5) AS mean, round(CAST(sd AS DOUBLE), 5) AS sd, round(CAST(least AS DOUBLE), 5) AS least, round(CAST(most AS DOUBLE), 5) AS most FROM {fkgl_stats}")
# a marker counts where its words follow each other as tokens; only its first word is joined on
relation("connective_hits", """
WITH t AS (SELECT doc_id, word, concat_ws(' ', word, lead(word) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w, lead(word, 4) OVER w, lead(word, 5) OVER w, '') AS ahead FROM {tokens} WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT t.doc_id, c.marker, count(*) AS hits FROM t JOIN (SELECT marker, split_part(marker, ' ', 1) AS head FROM {connectives}) c ON c.head = t.word AND substr(t.ahead, 1, length(c.marker) + 1) = concat(c.marker, ' ') GROUP BY t.doc_id, c.marker""")
relation("connective", "SELECT d.doc_id, coalesce(sum(h.hits), 0) AS hits, 1000.0 * coalesce(sum(h.hits), 0) / max(d.n) AS density FROM {doc_totals} d LEFT JOIN {connective_hits} h ON h.doc_id = d.doc_id GROUP BY d.doc_id", spark="SELECT doc_id, hits, 1000.0 * hits / n AS density FROM {measures} WHERE n > 0")
query("connective_density", "SELECT doc_id, CAST(hits AS BIGINT) AS hits, round(CAST(density AS DOUBLE), 6) AS per_1000 FROM {connective}")
query("function_word_ratio", """
SELECT w.doc_id, round(sum(CASE WHEN f.word IS NOT NULL THEN c ELSE 0 END) * 1.0 / sum(c), 6) AS ratio, count(f.word) AS kinds FROM {doc_words} w LEFT JOIN {function_words} f ON f.word = w.word GROUP BY w.doc_id""")
query("function_word_fingerprint", """
WITH r AS (SELECT w.doc_id, w.word, c, row_number() OVER (PARTITION BY w.doc_id ORDER BY c DESC, w.word) AS k FROM {doc_words} w JOIN {function_words} f ON f.word = w.word)
SELECT doc_id, word, c AS n, k FROM r WHERE k <= 10""")
query("punctuation_profile", """
WITH p AS (SELECT d.doc_id, t.n, d.text FROM {documents} d JOIN {doc_totals} t ON t.doc_id = d.doc_id)
SELECT doc_id, round(100.0 * @COUNT(text;;,)@ / n, 6) AS comma, round(100.0 * @COUNT(text;;[;])@ / n, 6) AS semicolon, round(100.0 * @COUNT(text;;:)@ / n, 6) AS colon,
  round(100.0 * (@COUNT(text;;--)@ + @COUNT(text;;[—–])@) / n, 6) AS dash, round(100.0 * (@COUNT(text;;\\.\\.\\.)@ + @COUNT(text;;…)@) / n, 6) AS ellipsis,
  round(100.0 * least(@COUNT(text;;\\()@, @COUNT(text;;\\))@) / n, 6) AS paren_pair, round(100.0 * @COUNT(text;;["“”])@ / n, 6) AS quote_mark, @COUNT(text;;[.?!])@ AS terminal FROM p""")
query("paragraph_profile", """
WITH p AS (SELECT doc_id, @COUNT(lower(line);;[a-z']+)@ AS w, line FROM {lines})
SELECT doc_id, count(*) AS paragraphs, round(avg(w), 6) AS mean, round(stddev_samp(w), 6) AS sd, round(avg(CAST(CASE WHEN w <= 25 THEN 1 ELSE 0 END AS DOUBLE)), 6) AS short_share,
  round(@PCT(w;;0.75)@, 6) AS p75, round(stddev_samp(w) / nullif(avg(w), 0), 6) AS cv FROM p WHERE @MATCH(line;;\\S)@ GROUP BY doc_id""")
query("pronoun_modal_profile", """
SELECT w.doc_id, s.category, round(1000.0 * sum(w.c) / max(t.n), 6) AS per_1000 FROM {doc_words} w JOIN {word_sets} s ON s.word = w.word JOIN {doc_totals} t ON t.doc_id = w.doc_id GROUP BY w.doc_id, s.category""")
query("punctuation_cadence", """
WITH s AS (SELECT doc_id, substr(trim(sent), length(trim(sent)), 1) AS mark FROM {sents})
SELECT doc_id, count(*) AS finals, round(avg(CASE WHEN mark = '.' THEN 1.0 ELSE 0.0 END), 6) AS period_share, round(avg(CASE WHEN mark = '?' THEN 1.0 ELSE 0.0 END), 6) AS question_share, round(avg(CASE WHEN mark = '!' THEN 1.0 ELSE 0.0 END), 6) AS exclamation_share FROM s GROUP BY doc_id""")
query("function_word_bigrams", """
WITH t AS (SELECT doc_id, pos, word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS next_word FROM {tokens})
SELECT t.lang_free AS grp, t.word, t.next_word, count(*) AS n FROM (SELECT 'all' AS lang_free, word, next_word FROM t) t JOIN {function_words} a ON a.word = t.word JOIN {function_words} b ON b.word = t.next_word GROUP BY t.lang_free, t.word, t.next_word""")
query("adjacency_network", """
WITH t AS (SELECT doc_id, word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS next_word FROM {tokens}),
e AS (SELECT doc_id, t.word AS a, t.next_word AS b, count(*) AS c FROM t JOIN {function_words} x ON x.word = t.word JOIN {function_words} y ON y.word = t.next_word GROUP BY doc_id, t.word, t.next_word)
SELECT doc_id, count(*) AS edges, CAST(sum(c) AS BIGINT) AS weight, count(DISTINCT a) AS sources, count(DISTINCT b) AS targets FROM e GROUP BY doc_id""")
query("document_layout", """
SELECT doc_id, count_if(@MATCH(line;;^#+ )@) AS headings, count_if(@MATCH(line;;^\\s*([-*+]|[0-9]+[.]) )@) AS list_items, count_if(@MATCH(line;;^>)@) AS quotes, count_if(@MATCH(line;;[|].*[|])@) AS table_lines, count_if(NOT @MATCH(line;;\\S)@) AS blank_lines, count(*) AS n_lines FROM {lines} GROUP BY doc_id""")
query("sound_texture", """
WITH t AS (SELECT doc_id, word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM {tokens})
SELECT doc_id, count_if(nxt IS NOT NULL AND @FIRST(word;;^[b-df-hj-np-tv-z]+)@ <> '' AND @FIRST(word;;^[b-df-hj-np-tv-z]+)@ = @FIRST(nxt;;^[b-df-hj-np-tv-z]+)@) AS alliterations,
  round(CAST(sum(@COUNT(word;;[aeiou])@) AS DOUBLE) / sum(length(word)), 6) AS vowel_ratio, round(CAST(sum(@COUNT(word;;[szx])@) AS DOUBLE) / sum(length(word)), 6) AS sibilant_ratio FROM t GROUP BY doc_id""")
_KICKERS = """
SELECT doc_id, count(*) AS paragraphs, count_if(@COUNT(lower(last_sentence);;[a-z']+)@ BETWEEN 1 AND 15 AND @MATCH(last_sentence;;[.]$)@ AND NOT @MATCH(last_sentence;;[0-9])@ AND NOT @MATCH(trim(last_sentence);; [A-Z])@) AS kickers FROM s GROUP BY doc_id"""
# the last sentence is sought from where a sentence may begin, without going back: in time of the line's length, not its square
query("kicker_density", """
WITH s AS (SELECT l.doc_id, l.lnum, @FIRST(trim(line);;[^.!?]+[.!?]$)@ AS last_sentence FROM {lines} l WHERE @MATCH(line;;\\S)@)""" + _KICKERS, spark="""
WITH s AS (SELECT l.doc_id, l.lnum, @FIRST(trim(line);;(?<![^.!?])[^.!?]++[.!?]\\z)@ AS last_sentence FROM {lines} l WHERE @MATCH(line;;\\S)@)""" + _KICKERS)
query("aux_profile", """
SELECT doc_id, round(1000.0 * @COUNT(text;;[.,;:!?'"()-])@ / nullif(length(text), 0), 3) AS punctuation_per_1k, round(CAST(@COUNT(text;;[^\\x00-\\x7F])@ AS DOUBLE) / nullif(@COUNT(text;;\\p{L})@, 0), 4) AS non_ascii_ratio,
  round(CAST(@COUNT(text;;\\p{Lu})@ AS DOUBLE) / nullif(@COUNT(text;;\\p{L})@, 0), 4) AS uppercase_ratio, round(CAST(@COUNT(text;;\\s)@ AS DOUBLE) / nullif(length(text), 0), 4) AS whitespace_ratio FROM {documents}""")
# at least five letters beyond ASCII, and at least 0.5 % of all letters
query("code_switching", """
WITH c AS (SELECT doc_id, @COUNT(text;;\\p{L})@ AS letters, @COUNT(text;;\\p{L})@ - @COUNT(text;;[A-Za-z])@ AS beyond FROM {documents})
SELECT doc_id, letters, beyond, beyond >= 5 AND beyond * 1000 >= letters * 5 AS switched FROM c""")
query("agency_densities", """
SELECT doc_id, round(1000.0 * count_if(@MATCH(word;;(tion|ment|ness|ity)s?$)@) / count(*), 6) AS nominalisation, round(1000.0 * count_if(@MATCH(word;;(ed|en)$)@) / count(*), 6) AS participles FROM {tokens} GROUP BY doc_id""")
query("stance_markers", """
WITH m AS (SELECT w.doc_id, sum(CASE WHEN s.category = 'hedge' THEN c ELSE 0 END) AS hedges, sum(CASE WHEN s.category = 'modal' THEN c ELSE 0 END) AS modals, sum(CASE WHEN s.category = 'negation' THEN c ELSE 0 END) AS negations FROM {doc_words} w JOIN {word_sets} s ON s.word = w.word GROUP BY w.doc_id)
SELECT doc_id, CAST(hedges AS BIGINT) AS hedges, CAST(modals AS BIGINT) AS modals, CAST(negations AS BIGINT) AS negations, round(hedges / nullif(hedges + modals, 0), 6) AS hedge_share FROM m""")

relation("signals", """
SELECT doc_id, 'burstiness_B' AS signal, CAST((sd - mean) / nullif(sd + mean, 0) AS DOUBLE) AS value FROM {sentence_stats}
UNION ALL SELECT doc_id, 'sentence_length_sd', CAST(sd AS DOUBLE) FROM {sentence_stats}
UNION ALL SELECT doc_id, 'connective_density', CAST(density AS DOUBLE) FROM {connective}
UNION ALL SELECT doc_id, 'mattr', CAST(mattr AS DOUBLE) FROM {mattr}
UNION ALL SELECT doc_id, 'yules_k', CAST(k AS DOUBLE) FROM {yule}
UNION ALL SELECT doc_id, 'shannon_entropy', CAST(bits AS DOUBLE) FROM {entropy}
UNION ALL SELECT doc_id, 'fkgl_sd', CAST(sd AS DOUBLE) FROM {fkgl_stats}""", spark="""
SELECT doc_id, stack(7, 'burstiness_B', (coalesce(sqrt(s_var), 0) - s_mean) / nullif(coalesce(sqrt(s_var), 0) + s_mean, 0), 'sentence_length_sd', CASE WHEN s_n > 0 THEN coalesce(sqrt(s_var), 0.0) END,
  'connective_density', 1000.0 * hits / n, 'mattr', mattr, 'yules_k', 10000.0 * (squares - n) / (n * n), 'shannon_entropy', bits, 'fkgl_sd', sqrt(g_var)) AS (signal, value) FROM {measures} WHERE n > 0""")
relation("flags", """
SELECT s.doc_id, s.signal, t.family, t.weight, CASE WHEN (t.direction = 'lt' AND round(s.value, 6) < t.threshold) OR (t.direction = 'gt' AND round(s.value, 6) > t.threshold) THEN 1 ELSE 0 END AS flagged
FROM {signals} s JOIN {thresholds} t ON t.signal = s.signal JOIN {doc_totals} d ON d.doc_id = s.doc_id WHERE s.value IS NOT NULL AND d.n >= t.floor_words""")
query("signal_table", "SELECT doc_id, signal, round(value, 5) AS value FROM {signals} WHERE value IS NOT NULL")
_BAND = "CASE WHEN f < 0.15 THEN 'low' WHEN f < 0.40 THEN 'moderate' ELSE 'high' END"
query("compression_verdict", f"""
WITH v AS (SELECT doc_id, count(*) AS available, sum(weight * flagged) / sum(weight) AS f FROM {{flags}} GROUP BY doc_id)
SELECT doc_id, available, round(f, 6) AS fraction, {_BAND} AS band FROM v""")
query("compression_ablation", f"""
WITH v AS (SELECT x.doc_id, a.family AS without, sum(x.weight * x.flagged) / sum(x.weight) AS f FROM {{flags}} x CROSS JOIN (SELECT DISTINCT family FROM {{thresholds}}) a WHERE x.family <> a.family GROUP BY x.doc_id, a.family)
SELECT doc_id, without, round(f, 6) AS fraction, {_BAND} AS band FROM v""")
