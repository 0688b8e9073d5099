"""DuckDB statements for the queries that SQL can express."""

#: Base 32 of a SHA-1: every five hex digits (20 bits) give four characters.
_BASE32 = """array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(h, (i // 4)::INT * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '')"""

#: Terms of a lexical search: only A-Z are folded.
_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

SQL: dict[str, str] = {
    "op5_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
             d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS h FROM p),
             f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
        SELECT page_id, n::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d JOIN f USING (h)""",
    "op4_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (
            SELECT *, length(regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|/?INST\]|</?SYS>>|\|endoftext\|>)', '\1\\\2\3', 'g')) AS chars,
                   (lag(role) OVER o IS DISTINCT FROM role OR row_number() OVER o = 1)::INT AS starts
            FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               -- marks: <|im_start|>, role, line feed, <|im_end|>, line feed for a block; <|im_sep|> within one
               (sum(chars) + sum(starts * (24 + length(role))) + 10 * (count(*) - sum(starts)))::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op8_quality_cascade": r"""
        WITH d AS (
            SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents),
        w AS (SELECT id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
        win AS (
            SELECT id, i, CASE WHEN lead(word, 7) OVER o IS NOT NULL THEN
                list(word) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) END AS k,
                (lead(word) OVER o = word)::INT AS same
            FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
        again AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, k) AS n FROM win WHERE k IS NOT NULL) WHERE n > 1),
        rep AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY id),
        adj AS (SELECT id, sum(same) AS n FROM win GROUP BY id),
        m AS (
            SELECT doc_id, text, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                   len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
                   (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
                   coalesce(adj.n, 0) AS adjacent, len(regexp_extract_all(text, '[^\n]+')) AS full_lines,
                   len(regexp_extract_all(text, '\p{L}')) AS letters, len(regexp_extract_all(text, '(?m)(\.\.\.|…)\s*$')) AS ellipses,
                   len(regexp_extract_all(text, '(?m)^\s*[-*•]')) AS bullets
            FROM d LEFT JOIN rep USING (id) LEFT JOIN adj USING (id)),
        b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR n_symbols * 10 > n_words
                    OR n_dup_lines * 2 > full_lines OR adjacent * 10 > 3 * n_words OR letters * 10 < 6 * word_chars
                    OR ellipses * 10 > 3 * full_lines OR bullets * 10 > 9 * full_lines) AS kept
        FROM b""",
    "op11_filter_audit": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                   min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
            FROM documents),
        f AS (
            SELECT part, quality, toxic,
                   (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
                   + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::INT
                   + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > least)::INT AS mask
            FROM d LEFT JOIN labels USING (doc_id)),
        m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
              FROM f GROUP BY part, mask),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
        orders(filter_order, used) AS (
            SELECT '', 0 UNION ALL SELECT filter_order || x, used + bit FROM orders, letters WHERE used & bit = 0),
        steps AS (
            SELECT o.filter_order, i.step, l.bit,
                   coalesce((SELECT sum(b.bit) FROM letters b WHERE contains(substr(o.filter_order, 1, i.step::INT - 1), b.x)), 0)::INT AS earlier
            FROM (SELECT filter_order FROM orders WHERE used = 31) o, (SELECT unnest(range(1, 6)) AS step) i, letters l
            WHERE l.x = substr(o.filter_order, i.step::INT, 1)),
        r AS (
            SELECT part, filter_order, step::INT AS step, bit,
                   coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0)::BIGINT AS kept,
                   coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (mask & earlier <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
                   coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
                   coalesce(sum(good) FILTER (mask & earlier = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
                   coalesce(sum(toxic) FILTER (mask & earlier = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
            FROM m, steps GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
        FROM r""",
    "op12_lexical_search": rf"""
        WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
        s AS (SELECT count(*) AS total, sum(len(terms))::BIGINT AS length FROM d WHERE len(terms) > 0),
        q AS (SELECT item_id, term, count(*) AS times
              FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
        p AS (SELECT id, doc_id, n, term, count(*) AS tf FROM (SELECT id, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
              WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * any_value(total) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, s GROUP BY term),
        r AS (
            SELECT item_id, id, doc_id,
                   sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * total) // length))))::BIGINT AS score
            FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, id, doc_id)
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
        FROM r WHERE score > 0 QUALIFY rank <= 20""",
}
