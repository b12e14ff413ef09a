"""SQL twins of the opN_ queries that SQL can express over whole tables."""

#: What the operator must find again: each turn replies to the one before, and its own text is the table's.
OP1_SQL = r"""SELECT conv_id, turn, role, regexp_replace(text, '^\n+|\n+$', '', 'g') AS own_text, least(turn, 2) AS levels,
CASE WHEN turn > 0 THEN conv_id END AS to_conv, CASE WHEN turn > 0 THEN turn - 1 END AS to_turn, conv_id AS root_conv, 0::BIGINT AS root_turn, turn AS depth FROM conversations"""

OP11_SQL = r"""WITH RECURSIVE texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, [x FOR x IN string_split_regex(text, '[\x20\x09-\x0D]+') IF x <> ''] AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM texts),
judged AS (SELECT doc_id, part, {'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
  'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)} AS fails FROM split),
flagged AS (SELECT part, fails.A AS a, fails.B AS b, fails.C AS c, fails.D AS d, fails.E AS e, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
  doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM judged),
grouped AS (SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failed,
  count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flagged GROUP BY ALL),
letters(letter) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
growing(filter_order) AS (SELECT letter FROM letters UNION ALL SELECT filter_order || letter FROM growing, letters WHERE NOT contains(filter_order, letter)),
steps AS (SELECT filter_order, k AS step, substr(filter_order, k, 1) AS letter, substr(filter_order, 1, k - 1) AS before FROM growing, range(1, 6) AS r(k) WHERE length(filter_order) = 5),
met AS (SELECT g.*, s.*, contains(failed, letter) AS fails, failed <> '' AND regexp_matches(failed, '[' || before || '_]') AS gone FROM grouped g, steps s),
counted AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed,
  coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant, coalesce(sum(n) FILTER (failed = letter), 0) AS unique_fails,
  coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS toxic_lost FROM met GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM counted"""

def _leaf(text: str) -> str:
    fields = ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256(concat({fields}))"


#: A-Z alone is lower-cased: translate() knows no other letters. The CRC is taken bit by bit.
OP12_SQL = rf"""WITH RECURSIVE ids AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS id FROM documents),
bits(id, i, crc) AS (SELECT id, 0, 4294967295::BIGINT FROM ids UNION ALL
  SELECT id, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM (SELECT id, i, CASE WHEN i % 8 = 0 THEN xor(crc, ascii(substr(id, i // 8 + 1, 1))::BIGINT) ELSE crc END AS x FROM bits WHERE i < 8 * length(id))),
crcs AS (SELECT id, xor(arg_max(crc, i), 4294967295) AS crc FROM bits GROUP BY id),
changed AS (SELECT d.*, CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS text_now FROM documents d JOIN crcs ON id = coalesce(doc_id::VARCHAR, '')),
made AS (SELECT doc_id, source, {_leaf("text")} AS leaf, {_leaf("text_now")} AS now FROM changed),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM made),
low(tree, lvl, idx, n, h) AS (SELECT tree, 0, idx, n, leaf FROM placed UNION ALL
  SELECT tree, lvl + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY tree, lvl, idx // 16, n),
high(lvl, idx, n, h) AS (SELECT 0, tree, count(*) OVER (), h FROM low WHERE n = 1 UNION ALL
  SELECT lvl + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY lvl, idx // 16, n),
nodes AS (SELECT tree, lvl, idx, n, h FROM low WHERE n > 1 UNION ALL SELECT -1, lvl, idx, n, h FROM high WHERE n > 1),
starts AS (SELECT row_number() OVER () AS k, * FROM placed),
ways AS (SELECT k, tree AS part, idx AS pos, 0 AS top FROM starts UNION ALL SELECT k, -1, tree, 1 FROM starts),
sides AS (SELECT k, top, lvl, coalesce(string_agg(h, '' ORDER BY n.idx) FILTER (n.idx < (pos >> (4 * lvl)::INTEGER)), '') AS l, coalesce(string_agg(h, '' ORDER BY n.idx) FILTER (n.idx > (pos >> (4 * lvl)::INTEGER)), '') AS r
  FROM ways w JOIN nodes n ON n.tree = part AND (n.idx >> 4) = (pos >> (4 * lvl + 4)::INTEGER) GROUP BY k, top, lvl, pos),
steps AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY top, lvl) AS step FROM sides),
folds(k, step, h) AS (SELECT k, 0, now FROM starts UNION ALL SELECT f.k, f.step + 1, sha256(l || h || r) FROM folds f JOIN steps s ON s.k = f.k AND s.step = f.step + 1),
folded AS (SELECT k, arg_max(h, step) AS folded_root FROM folds GROUP BY k),
proof AS (SELECT k, string_agg(l || r, '' ORDER BY step) AS joined FROM steps GROUP BY k)
SELECT doc_id, leaf, low.h AS subroot, high.h AS root, sha256(coalesce(joined, '')) AS proof_sha256, folded_root, folded_root = high.h AS verified
FROM starts s JOIN low ON low.tree = s.tree AND low.n = 1 JOIN high ON high.n = 1 JOIN folded f ON f.k = s.k LEFT JOIN proof p ON p.k = s.k"""

OP13_SQL = r"""WITH split AS (SELECT row_number() OVER () AS k, doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM documents),
windows AS (SELECT k, doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM split WHERE len(words) >= 13),
held AS (SELECT k, doc_id, i, array_to_string(words[i:i + 12], ' ') AS w FROM windows),
first AS (SELECT w, min(doc_id) AS first FROM held GROUP BY w),
gone AS (SELECT DISTINCT k, i + unnest(range(13)) AS i FROM held JOIN first USING (w) WHERE doc_id > first),
each AS (SELECT k, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM split),
kept AS (SELECT k, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS joined FROM each ANTI JOIN gone USING (k, i) GROUP BY k)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(joined, '')) AS kept_sha256 FROM split LEFT JOIN kept USING (k)"""
