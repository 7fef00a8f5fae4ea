"""Hygiene, normalisation, masking, validation and transforms."""

from inkstone.plans.catalogue import query, relation

query("strip_html", """
SELECT page_id, trim(@SUB(@SUB(@SUB(html;;(?is)<(script|style|nav)[^>]*>.*?</(script|style|nav)>;; )@;;<[^>]+>;; )@;;\\s+;; )@) AS text FROM {pages}""")
query("page_links", "SELECT page_id, @COUNT(html;;<a [^>]*href=)@ AS links, @COUNT(html;;<p[ >])@ AS paragraphs, @COUNT(html;;<h[1-6])@ AS headings, @COUNT(html;;<li[ >])@ AS list_items FROM {pages}")
query("page_domains", """
WITH d AS (SELECT @SUB(@FIRST(url;;^[a-z]+://[^/]+)@;;^[a-z]+://;;)@ AS domain FROM {pages})
SELECT domain, count(*) AS pages FROM d GROUP BY domain""")
query("reference_ecology", "SELECT page_id, @COUNT(html;;https?://)@ AS urls, @COUNT(html;;\\[[0-9]+\\])@ AS notes, @COUNT(html;;10[.][0-9]+/)@ AS dois, @COUNT(html;;[(][A-Z][a-z]+,? (19|20)[0-9][0-9][)])@ AS citations FROM {pages}")
query("slug_and_hash", "SELECT doc_id, substr(@SUB(@SUB(lower(substr(text, 1, 60));;[^a-z0-9]+;;-)@;;^-|-$;;)@, 1, 40) AS slug, concat('sha256:', @SHA(text)@) AS content_hash FROM {documents}")
query("era_bands", """
SELECT o_orderkey, CASE WHEN o_orderdate IS NULL THEN 'undated' WHEN @DAYS(o_orderdate)@ < '2022-11-01' THEN 'pre_chatgpt' WHEN @DAYS(o_orderdate)@ < '2024-07-01' THEN 'pre_ai_widespread' ELSE 'post_ai_widespread' END AS era FROM {orders}""")
query("redact_mail", "SELECT conv_id, turn, @SUB(text;;[A-Za-z0-9._%+-]+\\x40[A-Za-z0-9.-]+[.][A-Za-z]+;;[email])@ AS text FROM {conversations}")
query("redact_documents", "SELECT doc_id, @COUNT(text;;[A-Za-z0-9._%+-]+\\x40[A-Za-z0-9.-]+[.][A-Za-z]+)@ AS mails, @SHA(@SUB(text;;[A-Za-z0-9._%+-]+\\x40[A-Za-z0-9.-]+[.][A-Za-z]+;;[email])@)@ AS redacted_sha FROM {documents}")
query("content_fingerprint", "SELECT doc_id, @SHA(@SUB(trim(@SUB(lower(text);;[^a-z']+;; )@);; +;;_)@)@ AS fingerprint FROM {documents}")
relation("screen_lines", """
SELECT conv_id, lnum, line, @MATCH(line;;\\S)@ AS nonempty, @MATCH(line;;^[A-Z][A-Za-z ]*:)@ AS speaker, @MATCH(line;;[0-9]+:[0-9]+.*-->)@ OR trim(line) = 'WEBVTT' AS vtt,
  @COUNT(line;;[A-Za-z']+)@ AS words, @COUNT(concat(' ', @SUB(lower(line);;[^a-z']+;;  )@, ' ');; (um|uh|er|erm|hmm|mhm) )@ AS disfluent FROM {chat_lines}""")
query("transcript_screen", """
WITH s AS (SELECT conv_id, count_if(nonempty) AS lines, count_if(speaker) AS speakers, count_if(vtt) AS vtt, sum(words) AS words, sum(disfluent) AS disfluent, count_if(nonempty AND words BETWEEN 1 AND 5) AS short_lines FROM {screen_lines} GROUP BY conv_id)
SELECT conv_id, lines, speakers, vtt, CAST(words AS BIGINT) AS words, CAST(disfluent AS BIGINT) AS disfluencies, short_lines, vtt > 0 AS vtt_hit, lines > 0 AND speakers * 100 > lines * 15 AS speaker_hit, words > 0 AND disfluent * 1000 > words * 6 AS disfluency_hit, lines > 15 AND short_lines * 100 > lines * 55 AS short_hit FROM s""")
query("adversarial_transforms", "SELECT doc_id, @SHA(@SUB(text;;(?i)(^|[^a-z])(a|an|the) ;;$1)@)@ AS without_articles, @SHA(replace(replace(text, 'o', 'о'), 'e', 'е'))@ AS homoglyphs, @SHA(@SUB(text;; +;;  )@)@ AS spaced, length(replace(text, ' ', '')) AS squeezed FROM {documents}")
query("refusal_detection", "SELECT conv_id, turn, @MATCH(lower(text);;(i cannot|i can't|as an ai|i'm sorry))@ AS refusal, trim(@SUB(text;;\\s+;; )@) AS normal FROM {conversations}")
query("duplicate_keys", "SELECT source, lang, count(*) AS n, count(DISTINCT doc_id) AS ids FROM {documents} GROUP BY source, lang HAVING count(*) > 1")
query("status_labels", "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN quality = 0 THEN 0 END AS label FROM {labels} WHERE quality = 0 OR toxic = 0")
query("length_buckets", """
SELECT doc_id, n AS n_words, CASE WHEN n < 200 THEN '0-199' WHEN n < 500 THEN '200-499' WHEN n < 1000 THEN '500-999' WHEN n < 2000 THEN '1000-1999' WHEN n < 5000 THEN '2000-4999' ELSE '5000+' END AS bucket FROM (SELECT doc_id, CAST(n AS BIGINT) AS n FROM {doc_totals}) x""")
query("register_isolation", "SELECT source, count(DISTINCT lang) AS tiers, count(DISTINCT lang) > 1 AS refused FROM {documents} GROUP BY source")
query("manifest_filters", "SELECT doc_id, source FROM {documents} WHERE lang IN ('en', 'de') AND source <> 'src0' AND n_chars BETWEEN 200 AND 5000")
query("validation_issues", """
SELECT doc_id, 'error' AS severity, 'text' AS field FROM {documents} WHERE text IS NULL OR trim(text) = ''
UNION ALL SELECT doc_id, 'warning', 'n_chars' FROM {documents} WHERE n_chars <> length(text)
UNION ALL SELECT doc_id, 'warning', 'lang' FROM {documents} WHERE lang NOT IN ('en', 'fr')""")
query("ocr_garbage", "SELECT doc_id, round(CAST(@COUNT(text;;[^A-Za-z0-9\\s.,;:'\"-])@ AS DOUBLE) / nullif(length(text), 0), 6) AS odd_share, @COUNT(text;;[^A-Za-z0-9\\s.,;:'\"-])@ * 4 > length(text) AS garbage FROM {documents}")
