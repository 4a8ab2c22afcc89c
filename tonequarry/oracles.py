"""SQL of the registered queries for DuckDB over the same tables."""

from __future__ import annotations

#: The domain views, as common table expressions.
PRELUDE = r"""WITH raw AS (
  SELECT e.vec_id AS song_id,
         CASE WHEN e.vec_id % 3 = 0 THEN p.p_brand || ' - ' || p.p_name ELSE p.p_name END AS title,
         CASE WHEN e.vec_id % 3 = 0 AND p.p_brand IS NOT NULL THEN '<unknown>' ELSE p.p_brand END AS artist,
         '/music/' || p.p_type || '/' || e.vec_id || '.mp3' AS path
  FROM embeddings e LEFT JOIN part p ON p.p_partkey = e.vec_id),
songs AS (
  SELECT song_id, coalesce(title, 'Unknown') AS title, coalesce(artist, 'Unknown') AS artist,
         CASE WHEN regexp_extract(coalesce(path, ''), '([^/]+)/[^/]+$', 1) = '' THEN 'Unknown'
              ELSE regexp_extract(coalesce(path, ''), '([^/]+)/[^/]+$', 1) END AS folder
  FROM raw),
tracks AS (SELECT vec_id AS song_id, embedding::DOUBLE[] AS vector, label FROM embeddings WHERE embedding IS NOT NULL),
plays AS (
  SELECT *, (60000 + (song_id % 5) * 15000)::BIGINT AS duration_ms FROM (
    SELECT event_id AS id, user_id AS listener, (props::JSON ->> '$.k')::BIGINT AS song_id,
           epoch_us(ts) // 1000 AS played_at, floor(value * 1000)::BIGINT AS played_ms, event_type FROM events)),
listens AS (SELECT * FROM plays WHERE played_ms >= 3000),
fractions AS (
  SELECT *, CASE WHEN duration_ms <= 0 THEN 0.0::DOUBLE
                 ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, played_ms::DOUBLE / duration_ms)) END AS fraction FROM listens),
lastp AS (SELECT song_id, max(played_at) AS last_played FROM listens GROUP BY song_id),
favs AS (SELECT song_id FROM tracks WHERE song_id % 17 = 0),
tastes AS (
  SELECT listener, song_id, played_at,
         CASE WHEN fraction >= 0.8 THEN 1.0::DOUBLE WHEN fraction >= 0.3 THEN 0.3::DOUBLE ELSE -0.7::DOUBLE END
         * exp(-ln(2.0::DOUBLE) * (greatest(0, 1706659200000 - played_at) / 86400000.0::DOUBLE) / 21.0::DOUBLE) AS w
  FROM fractions WHERE played_at >= 1706659200000 - 90 * 86400000::BIGINT),
weights AS (SELECT song_id, sum(w) AS weight FROM (SELECT song_id, w FROM tastes UNION ALL SELECT song_id, 2.0::DOUBLE FROM favs) GROUP BY song_id),
heads AS (
  SELECT *, regexp_matches(own, '(?s)^.*?(?:\s+[-–—]\s+|\s+[-–—]|[-–—]\s+).*$') AS parted,
         regexp_replace(regexp_replace(regexp_extract(own, '(?s)^(.*?)(?:\s+[-–—]\s+|\s+[-–—]|[-–—]\s+)(.*)$', 1), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '^[_. ]+|[_. ]+$', '', 'g') AS head,
         regexp_replace(regexp_extract(own, '(?s)^(.*?)(?:\s+[-–—]\s+|\s+[-–—]|[-–—]\s+)(.*)$', 2), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS tail
  FROM (SELECT *, regexp_replace(title, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS own FROM songs)),
leads AS (
  SELECT *, lower(regexp_replace(regexp_replace(head, '(?i)\s+(?:feat\.?|ft\.?|featuring|with)\s.*$', ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS lead
  FROM heads),
intitle AS (
  SELECT *, CASE WHEN parted AND tail <> '' AND length(head) BETWEEN 2 AND 60 AND regexp_matches(head, '\p{L}') AND length(lead) >= 2 THEN lead END AS title_act,
         regexp_replace(title, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS whole,
         regexp_replace(artist, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS tag
  FROM leads),
acts AS (
  SELECT song_id, title, artist, folder,
         coalesce(CASE WHEN tag <> '' AND lower(tag) <> '<unknown>' THEN lower(tag) END, title_act, lower(folder)) AS act,
         CASE WHEN title_act IS NOT NULL THEN tail ELSE whole END AS song,
         CASE WHEN lower(tag) <> '<unknown>' AND regexp_matches(tag, '\p{L}') THEN tag
              WHEN strpos(title, ' - ') > 1 AND length(front) BETWEEN 2 AND 40 AND regexp_matches(front, '\p{L}') THEN front END AS display
  FROM (SELECT *, regexp_replace(regexp_replace(substr(title, 1, strpos(title, ' - ') - 1), '^[\d. ]+', ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS front FROM intitle)),
keyed AS (SELECT *, act || '|' || lower(song) AS duplicate_key FROM acts),
mixt AS (
  SELECT t.song_id, t.vector, k.act AS grp, k.duplicate_key, l.last_played
  FROM tracks t JOIN keyed k USING (song_id) LEFT JOIN lastp l USING (song_id)),
pool0 AS (
  SELECT m.*, coalesce(w.weight, 0.0::DOUBLE) AS weight,
         (m.song_id % 11 <> 0) AND (last_played IS NULL OR 1706659200000 - last_played > 3 * 86400000::BIGINT)
         AND (coalesce(w.weight, 0) > -0.5 OR m.song_id % 17 = 0) AS good
  FROM mixt m LEFT JOIN weights w USING (song_id)),
pool AS (SELECT * FROM pool0 WHERE good OR NOT (SELECT coalesce(bool_or(good), false) FROM pool0)),
draws AS (
  SELECT *, -ln((('0x' || substr(md5('20240131:' || song_id), 1, 8))::UBIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / greatest(weight, 0.01::DOUBLE) AS draw
  FROM pool WHERE weight > 0 OR NOT (SELECT coalesce(bool_or(weight > 0), false) FROM pool)),
anchors AS (SELECT * FROM draws ORDER BY draw, song_id LIMIT 4),
flat AS (SELECT song_id, label, unnest(vector) AS x, unnest(range(len(vector))) AS pos FROM tracks),
centre AS (SELECT list(m ORDER BY pos) AS c FROM (SELECT pos, avg(x) AS m FROM flat GROUP BY pos)),
labelv AS (SELECT label AS label_idx, list(m ORDER BY pos) AS vector FROM (SELECT label, pos, avg(x) AS m FROM flat GROUP BY label, pos) GROUP BY label),
own0 AS (SELECT song_id, list_transform(range(1, len(vector) + 1), lambda i: vector[i] - c[i]) AS d FROM tracks, centre),
own AS (SELECT song_id, CASE WHEN list_dot_product(d, d) > 0 THEN list_transform(d, lambda x: x / sqrt(list_dot_product(d, d))) ELSE d END AS u FROM own0),
dirn AS (SELECT u AS direction FROM own WHERE song_id = 7),
wscore AS (
  SELECT o.song_id, 0.75::DOUBLE * list_dot_product(d.direction, o.u) + 0.25::DOUBLE * list_dot_product(k.u, o.u)
         - 0.9::DOUBLE * 2.0::DOUBLE / (2.0::DOUBLE + 2.0::DOUBLE) * list_dot_product(a.u, o.u)
         + CASE WHEN l.last_played IS NULL THEN 0.125::DOUBLE ELSE 0.0::DOUBLE END AS score
  FROM own o, dirn d, (SELECT u FROM own WHERE song_id = 9) a, (SELECT u FROM own WHERE song_id = 12) k, (SELECT 1) z, LATERAL (SELECT (SELECT last_played FROM lastp WHERE lastp.song_id = o.song_id) AS last_played) l)
"""

_COS = "list_cosine_similarity(t.vector, q.vector)"

_BODIES: dict[str, str] = {
    "library_scan": "SELECT song_id, title, artist, folder FROM songs ORDER BY title, song_id",
    "embedding_scan": "SELECT song_id, len(vector)::INTEGER AS dims, round(list_sum(vector), 6) AS total FROM tracks",
    "embedding_ids": "SELECT song_id FROM tracks",
    "embedding_count": "SELECT count(*) AS n FROM tracks",
    "upsert_latest": "SELECT song_id, id, played_at FROM plays QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY played_at DESC, id DESC) = 1",
    "streamed_upsert": "SELECT song_id, id, played_at FROM plays QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY played_at DESC, id DESC) = 1",
    "scan_backlog": """, f AS (SELECT song_id, max(played_at) AS modified FROM plays GROUP BY song_id),
 st AS (SELECT song_id, max(played_at) AS modified FROM plays WHERE event_type <> 'error' GROUP BY song_id)
SELECT f.song_id, f.modified FROM f JOIN songs USING (song_id) LEFT JOIN st ON st.song_id = f.song_id AND f.song_id % 3 = 2 AND st.modified >= f.modified WHERE st.song_id IS NULL""",
    "listens_recorded": "SELECT id, listener, song_id, played_at, played_ms, duration_ms FROM listens",
    "listens_recent": "SELECT id, song_id, played_at FROM listens WHERE played_at >= 1706659200000 - 14 * 86400000::BIGINT",
    "listens_pruned": "SELECT count(*) AS kept, min(played_at) AS oldest FROM listens WHERE played_at >= 1706659200000 - 21 * 86400000::BIGINT",
    "legacy_vectors": "SELECT song_id, len(vector)::INTEGER AS dims, round(vector[1], 6) AS first FROM tracks WHERE song_id % 5 > 2",
    "binary_vectors": "SELECT song_id, len(vector)::INTEGER AS dims, round(list_sum(vector), 6) AS total FROM tracks",
    "current_analysis": "SELECT count(*) AS analysed FROM tracks WHERE song_id % 2 = 1",
    "daily_document": "SELECT '2024-01-30' AS day, 2 AS attempt, song_id, least(3, (SELECT count(*) FROM favs))::INTEGER AS recent_songs FROM favs",
    "albums_document": "SELECT label, song_id FROM tracks",
    "tsv_round_trip": "SELECT s.song_id, title, artist, folder, len(vector)::INTEGER AS dims, round(vector[2], 6) AS second FROM songs s JOIN tracks USING (song_id)",
    "media_deleted": "SELECT song_id, title FROM songs WHERE song_id NOT IN (SELECT song_id FROM favs)",
    "analysed_songs": "SELECT song_id, title FROM songs WHERE song_id IN (SELECT song_id FROM tracks)",
    "not_yet_scanned": "SELECT p_partkey AS song_id FROM part WHERE p_partkey NOT IN (SELECT song_id FROM tracks)",
    "plain_search": "SELECT song_id, title, artist FROM songs WHERE contains(lower(title), 'brand#1') OR contains(lower(artist), 'brand#1') ORDER BY title, song_id LIMIT 20",
    "scoped_search": "SELECT song_id, title, artist FROM songs WHERE (contains(lower(title), 'brand#2') OR contains(lower(artist), 'brand#2')) AND song_id IN (SELECT song_id FROM favs)",
    "document_search": "SELECT doc_id, source, length(text)::INTEGER AS chars FROM documents WHERE contains(lower(text), 'all rights reserved') ORDER BY doc_id LIMIT 20",
    "listen_fractions": """SELECT id, round(fraction, 6) AS fraction,
 CASE WHEN fraction >= 0.8 THEN 1.0::DOUBLE WHEN fraction >= 0.3 THEN 0.3::DOUBLE ELSE -0.7::DOUBLE END AS taste,
 CASE WHEN event_type = 'error' THEN -0.3::DOUBLE WHEN fraction >= 0.8 THEN 0.15::DOUBLE WHEN fraction < 0.3 THEN -0.1::DOUBLE ELSE 0.0::DOUBLE END AS steer FROM fractions""",
    "fresh_tracks": "SELECT song_id, last_played IS NULL OR 1706659200000 - 5 * 86400000::BIGINT - last_played > 30 * 86400000::BIGINT AS fresh FROM mixt",
    "mix_eligible": "SELECT song_id, round(weight, 6) AS weight FROM pool",
    "wave_relaxed": """, lv AS (SELECT song_id, CASE WHEN song_id % 7 = 0 THEN 3 WHEN last_played IS NOT NULL AND 1706659200000 - last_played < 31.5 * 86400000::BIGINT THEN 2
 WHEN song_id % 2 = 1 THEN 1 ELSE 0 END AS level FROM mixt WHERE song_id % 17 <> 0)
SELECT song_id, level::INTEGER AS level FROM lv WHERE level <= (SELECT min(level) FROM lv)""",
    "wave_hold_back": """, n AS (SELECT *, 3.0::DOUBLE + 57.0::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (song_id % 5) / 2.0::DOUBLE - 0.5::DOUBLE)) AS days FROM mixt)
SELECT song_id, round(days, 6) AS days, last_played IS NOT NULL AND coalesce(1706659200000 - last_played < days * 86400000::BIGINT, false) AS held FROM n""",
    "virtual_favourites": "SELECT 0 AS ordinal, 'Favourites' AS name, song_id FROM songs WHERE song_id IN (SELECT song_id FROM favs) UNION ALL SELECT 1, 'list ' || label, song_id FROM tracks",
    "persisted_playlists": "SELECT 'list ' || label AS name, count(*) AS songs FROM tracks GROUP BY label",
    "cyrillic_routing": "SELECT song_id, regexp_matches(CASE WHEN song_id % 4 = 0 THEN 'песня ' || title ELSE title END, '[а-яА-ЯёЁ]') AS cyrillic FROM songs",
    "slider_snap": "SELECT song_id, round(round(least(1.5::DOUBLE, greatest(0.5::DOUBLE, song_id / 300.0::DOUBLE)) * 20) / 20, 6) AS snapped FROM tracks",
    "size_gates": "SELECT n >= 8 AS albums, n >= 40 AS mix, n >= 40 AS wave, greatest(4, least(12, round_even(ln(greatest(n, 1)), 0)))::INTEGER AS min_points, greatest(20, least(60, floor(n * 0.15::DOUBLE)))::INTEGER AS cap FROM (SELECT count(*) AS n FROM tracks)",
    "resumable_sessions": """, l AS (SELECT * FROM plays QUALIFY row_number() OVER (PARTITION BY listener ORDER BY played_at DESC, id DESC) = 1)
SELECT listener, song_id, played_at FROM l WHERE 1706659200000 - played_at <= 172800000 AND song_id IN (SELECT song_id FROM tracks)""",
    "songs_with_vectors": "SELECT song_id, title, label FROM songs JOIN tracks USING (song_id)",
    "songs_last_played": "SELECT song_id, last_played FROM songs LEFT JOIN lastp USING (song_id)",
    "ordered_lookup": "SELECT row_number() OVER (ORDER BY song_id DESC) - 1 AS position, song_id, title FROM songs WHERE song_id IN (SELECT song_id FROM favs)",
    "weights_with_default": "SELECT song_id, round(coalesce(weight, 0.0::DOUBLE), 6) AS weight FROM tracks LEFT JOIN weights USING (song_id)",
    "close_pairs": "SELECT t.song_id AS a, q.song_id AS b, round(1 - list_dot_product(t.vector, q.vector), 6) AS distance FROM tracks t JOIN tracks q ON t.song_id < q.song_id AND 1 - list_dot_product(t.vector, q.vector) <= 0.65",
    "pivot_pairs": "SELECT t.song_id AS a, q.song_id AS b, round(1 - list_dot_product(t.vector, q.vector), 6) AS distance FROM tracks t JOIN tracks q ON t.song_id < q.song_id AND 1 - list_dot_product(t.vector, q.vector) <= 0.7",
    "anchor_closeness": "SELECT t.song_id, round(max(list_dot_product(t.vector, q.vector)), 6) AS closeness FROM tracks t, tracks q WHERE q.song_id IN (1, 2, 3, 4) GROUP BY t.song_id",
    "album_labels": """, s AS (SELECT song_id % 12 AS cluster, pos, sum(x) AS x FROM flat GROUP BY ALL),
 a0 AS (SELECT cluster, list(x ORDER BY pos) AS v FROM s GROUP BY cluster),
 a AS (SELECT cluster, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM a0),
 p AS (SELECT cluster, label_idx, list_dot_product(v, vector) - 0.5::DOUBLE * list_dot_product(vector, c) AS score FROM a, labelv, centre)
SELECT cluster, label_idx, round(score, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, label_idx) = 1""",
    "rank_agreement": """, c AS (SELECT song_id, vector, list_transform(vector, lambda x: round(x * 8) / 8) AS coarse FROM tracks),
 a AS (SELECT q.song_id AS query_id, t.song_id FROM c t, c q WHERE q.song_id % 100 = 0 AND t.song_id <> q.song_id QUALIFY row_number() OVER (PARTITION BY q.song_id ORDER BY list_dot_product(t.vector, q.vector) DESC, t.song_id) <= 10),
 b AS (SELECT q.song_id AS query_id, t.song_id FROM c t, c q WHERE q.song_id % 100 = 0 AND t.song_id <> q.song_id QUALIFY row_number() OVER (PARTITION BY q.song_id ORDER BY list_dot_product(t.coarse, q.coarse) DESC, t.song_id) <= 10)
SELECT t.song_id AS query_id, (SELECT count(*) FROM a JOIN b USING (query_id, song_id) WHERE a.query_id = t.song_id) AS shared FROM tracks t WHERE t.song_id % 100 = 0""",
    "rank_of_first": """, c AS (SELECT song_id, vector, list_transform(vector, lambda x: round(x * 8) / 8) AS coarse FROM tracks),
 a AS (SELECT q.song_id AS query_id, t.song_id FROM c t, c q WHERE q.song_id % 100 = 0 AND t.song_id <> q.song_id QUALIFY row_number() OVER (PARTITION BY q.song_id ORDER BY list_dot_product(t.vector, q.vector) DESC, t.song_id) = 1),
 b AS (SELECT q.song_id AS query_id, t.song_id, row_number() OVER (PARTITION BY q.song_id ORDER BY list_dot_product(t.coarse, q.coarse) DESC, t.song_id) AS r FROM c t, c q WHERE q.song_id % 100 = 0 AND t.song_id <> q.song_id)
SELECT query_id, song_id, r::INTEGER AS rank FROM a JOIN b USING (query_id, song_id) WHERE r <= 100""",
    "duplicate_groups": "SELECT duplicate_key, count(*) AS copies, min(song_id) AS first FROM keyed GROUP BY duplicate_key HAVING count(*) > 1",
    "songs_by_folder": "SELECT folder, count(*) AS songs, string_agg(song_id::VARCHAR, ',' ORDER BY title, song_id) AS ids FROM songs GROUP BY folder",
    "last_played": "SELECT song_id, last_played FROM lastp",
    "analysed_per_folder": """, r AS (SELECT p_type AS folder, t.song_id FROM part LEFT JOIN tracks t ON t.song_id = p_partkey)
SELECT folder, count(song_id) AS analysed, count(*) AS songs FROM r GROUP BY folder UNION ALL SELECT 'All tracks', count(song_id), count(*) FROM r""",
    "taste_weights": "SELECT song_id, round(weight, 6) AS weight FROM weights",
    "taste_weights_by_listener": "SELECT listener, song_id, round(sum(w), 6) AS weight FROM tastes GROUP BY listener, song_id",
    "taste_vector": "SELECT pos::INTEGER AS pos, round(sum(weight * x), 4) AS x FROM flat JOIN weights USING (song_id) WHERE weight > 0 GROUP BY pos",
    "library_centre": "SELECT pos::INTEGER AS pos, round(avg(x), 6) AS x FROM flat GROUP BY pos",
    "cluster_centroids": """, s AS (SELECT label, pos, sum(x) AS x FROM flat GROUP BY label, pos)
SELECT label AS cluster, pos::INTEGER AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM s""",
    "score_statistics": f"SELECT round(avg({_COS}), 6) AS mean, round(stddev_pop({_COS}), 6) AS deviation FROM tracks t, tracks q WHERE q.song_id = 0",
    "covariance": """, m AS (SELECT pos, avg(x) AS m FROM flat GROUP BY pos), c AS (SELECT song_id, pos, x - m AS x FROM flat JOIN m USING (pos))
SELECT p.pos::INTEGER AS i, q.pos::INTEGER AS j, round(sum(p.x * q.x), 4) AS g FROM c p JOIN c q ON p.song_id = q.song_id AND p.pos <= q.pos GROUP BY ALL
UNION ALL SELECT -1, -1, round(sum(x * x), 4) FROM c""",
    "clusters_by_size": "SELECT label AS cluster, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, min(song_id)) AS place FROM tracks GROUP BY label",
    "score_summary": f""", d AS (SELECT {_COS} AS s FROM tracks t, tracks q WHERE q.song_id = 0), o AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS r, count(*) OVER () AS n FROM d)
SELECT round(min(s), 6) AS least, round(max(s) FILTER (WHERE r = n // 10), 6) AS p10, round(max(s) FILTER (WHERE r = n // 2), 6) AS median, round(max(s) FILTER (WHERE r = n * 9 // 10), 6) AS p90, round(max(s), 6) AS most, max(n) AS n FROM o""",
    "art_uris": "SELECT song_id, 'content://media/external/audio/albumart/' || label AS art FROM tracks",
    "scan_progress": "SELECT label, song_id, row_number() OVER w AS done, ((count(*) OVER (PARTITION BY label) - row_number() OVER w) * (row_number() OVER w * 1230 // row_number() OVER w) // 1000)::BIGINT AS seconds_left FROM tracks WINDOW w AS (PARTITION BY label ORDER BY song_id)",
    "tsv_files": "SELECT title, artist, folder, len(vector)::INTEGER AS dims, round(vector[2], 6) AS second FROM songs JOIN tracks USING (song_id)",
    "document_files": "SELECT '2024-01-30' AS day, 2 AS attempt, song_id FROM favs",
    "cluster_sizes": "SELECT label AS cluster, count(*) AS size, min(song_id) AS first FROM tracks GROUP BY label",
    "cluster_coverage": """, s AS (SELECT song_id % 37 % 11 - 1 AS cluster, count(*) AS size FROM tracks GROUP BY 1)
SELECT coalesce(sum(size) FILTER (WHERE size BETWEEN 4 AND 50), 0)::BIGINT AS covered, max(size) AS largest FROM s WHERE cluster >= 0""",
    "dominant_artists": """, b AS (SELECT folder, display, count(*) AS n, min(song_id) AS f FROM acts WHERE display IS NOT NULL GROUP BY ALL), z AS (SELECT folder, count(*) AS size FROM acts GROUP BY folder)
SELECT folder AS cluster, display AS artist FROM b JOIN z USING (folder) QUALIFY row_number() OVER (PARTITION BY folder ORDER BY n DESC, f) = 1 AND 2 * n >= size""",
    "leading_artists": """, b AS (SELECT song_id % 6 AS cluster, display, count(*) AS n, min(song_id) AS f FROM acts WHERE display IS NOT NULL GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, f) AS r FROM b)
SELECT cluster, string_agg(display, ', ' ORDER BY r) AS subtitle FROM r WHERE r <= 3 GROUP BY cluster""",
    "distinct_groups": "SELECT greatest(1, count(DISTINCT act)) AS groups FROM acts",
    "distance_quantiles": f""", d AS (SELECT row_number() OVER (ORDER BY 1 - {_COS}) - 1 AS r, 1 - {_COS} AS d FROM tracks t, tracks q WHERE q.song_id = 0),
 k AS (SELECT k AS step, 0.001::DOUBLE + 0.149::DOUBLE * k / 39 AS q FROM range(40) x(k))
SELECT step::INTEGER AS step, round(d, 6) AS eps FROM k JOIN d ON r = floor(q * ((SELECT count(*) FROM d) - 1))""",
    "set_hashes": "SELECT label, sha256(string_agg(song_id::VARCHAR, ',' ORDER BY song_id)) AS id FROM tracks GROUP BY label",
    "asset_bytes": "SELECT p_brand AS kind, coalesce(sum(p_size) FILTER (WHERE p_size > 25), 0)::BIGINT AS missing FROM part GROUP BY p_brand",
    "distinct_over_days": "SELECT played_at // 86400000 AS day, count(DISTINCT song_id) AS songs, count(*) AS listens FROM listens GROUP BY 1",
    "artist_spread": "SELECT act, count(*) AS songs FROM acts GROUP BY act",
    "top_neighbours": """, r AS (SELECT q.song_id AS query_id, t.song_id, list_dot_product(t.vector, q.vector) AS score, row_number() OVER (PARTITION BY q.song_id ORDER BY list_dot_product(t.vector, q.vector) DESC, t.song_id) AS r
 FROM tracks t, tracks q WHERE q.song_id % 100 = 0 AND t.song_id <> q.song_id)
SELECT query_id, song_id, r::INTEGER AS rank, round(score, 6) AS score FROM r WHERE r <= 10""",
    "last_groups": """, r AS (SELECT listener, song_id, row_number() OVER (PARTITION BY listener ORDER BY played_at DESC, id DESC) AS r FROM listens)
SELECT listener, string_agg(song_id::VARCHAR, ',' ORDER BY r DESC) AS songs FROM r WHERE r <= 5 GROUP BY listener""",
    "variance_cut": """, s AS (SELECT label, count(*) AS n FROM tracks GROUP BY label),
 r AS (SELECT row_number() OVER (ORDER BY n DESC, label) AS k, sum(n) OVER (ORDER BY n DESC, label ROWS UNBOUNDED PRECEDING) AS s, sum(n) OVER () AS t FROM s)
SELECT greatest(4, least(12, coalesce(min(k) FILTER (WHERE s >= 0.6 * t), max(k))))::INTEGER AS k FROM r""",
    "windows_apart": """, p AS (SELECT listener, song_id, row_number() OVER (PARTITION BY listener ORDER BY played_at, id) AS position FROM listens),
 w AS (SELECT listener, len(list_distinct(list(song_id) OVER k)) = count(*) OVER k AS apart FROM p WINDOW k AS (PARTITION BY listener ORDER BY position ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT listener AS wave, count(*) FILTER (WHERE apart) AS apart, count(*) AS picks FROM w GROUP BY listener""",
    "listen_gaps": "SELECT id, played_at - lag(played_at) OVER (PARTITION BY listener ORDER BY played_at, id) AS gap FROM listens",
    "listening_sessions": """, g AS (SELECT *, CASE WHEN played_at - lag(played_at) OVER k >= 1800000 OR lag(played_at) OVER k IS NULL THEN 1 ELSE 0 END AS new FROM listens WINDOW k AS (PARTITION BY listener ORDER BY played_at)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY listener ORDER BY played_at ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT listener, min(played_at) AS start, count(*) AS listens, sum(played_ms)::BIGINT AS played_ms FROM s GROUP BY listener, s""",
    "vector_search": f""", z AS (SELECT t.song_id, {_COS} AS score FROM tracks t, labelv q WHERE q.label_idx = 3),
 k AS (SELECT song_id, score FROM z WHERE score >= (SELECT greatest(avg(score) + stddev_pop(score), 0.15::DOUBLE) FROM z) ORDER BY score DESC, song_id LIMIT 50)
SELECT song_id, round(score, 6) AS score, round(CASE WHEN score >= 0.45 THEN 0.99::DOUBLE WHEN score <= 0.15 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, (score - 0.15::DOUBLE) / (0.45::DOUBLE - 0.15::DOUBLE))) END, 6) AS shown FROM k""",
    "similar_tracks": f""", k AS (SELECT t.song_id, {_COS} AS score FROM tracks t, tracks q WHERE q.song_id = 0 AND t.song_id <> 0 ORDER BY score DESC, t.song_id LIMIT 30)
SELECT song_id, title, artist, round(score, 6) AS score FROM k JOIN songs USING (song_id) ORDER BY score DESC, song_id""",
    "smart_shuffle": f""", q0 AS (SELECT song_id % 2 AS queue_id, song_id, row_number() OVER (PARTITION BY song_id % 2 ORDER BY md5(song_id::VARCHAR)) - 1 AS position FROM tracks),
 n AS (SELECT queue_id, min(position) AS now FROM q0 WHERE song_id = 30 GROUP BY queue_id),
 s AS (SELECT q0.*, now, position > now AS up, CASE WHEN t.song_id IS NULL THEN -1.0::DOUBLE ELSE {_COS} END AS score
       FROM q0 JOIN n USING (queue_id) LEFT JOIN (SELECT * FROM tracks WHERE song_id % 5 <> 0 OR song_id = 30) t ON t.song_id = q0.song_id, (SELECT vector FROM tracks WHERE song_id = 30) q),
 r AS (SELECT *, row_number() OVER (PARTITION BY queue_id, up ORDER BY score DESC, position) AS r FROM s)
SELECT queue_id, row_number() OVER (PARTITION BY queue_id ORDER BY CASE WHEN NOT up THEN 0 WHEN r <= 5 THEN 1 ELSE 2 END, CASE WHEN up AND r <= 5 THEN r ELSE position END) - 1 AS position, song_id FROM r""",
    "all_folder_first": "SELECT 0 AS ordinal, 'All tracks' AS folder, count(*) AS songs FROM songs UNION ALL SELECT 1, folder, count(*) FROM songs GROUP BY folder",
    "playlist_append": """, h AS (SELECT 'p' || (song_id % 3) AS name, song_id // 6 AS position, song_id FROM tracks WHERE song_id % 2 = 0),
 e AS (SELECT name, max(position) + 1 AS e FROM h GROUP BY name),
 m AS (SELECT 'p' || (song_id % 3) AS name, song_id FROM tracks WHERE song_id % 2 <> 0)
SELECT name, position, song_id FROM h UNION ALL SELECT m.name, coalesce(e, 0) + row_number() OVER (PARTITION BY m.name ORDER BY song_id DESC) - 1, song_id FROM m LEFT JOIN e USING (name)""",
    "remembered_union": "SELECT DISTINCT song_id FROM tracks",
    "favourites_heard": "SELECT listener, count(DISTINCT song_id) FILTER (WHERE song_id IN (SELECT song_id FROM favs))::INTEGER AS shared FROM listens GROUP BY listener",
    "favourites_toggled": """, a AS (SELECT song_id, id, event_type FROM plays), d AS (SELECT song_id, max(id) AS since FROM a WHERE event_type = 'error' GROUP BY song_id)
SELECT song_id FROM a LEFT JOIN d USING (song_id) WHERE event_type = 'click' AND (since IS NULL OR id > since) GROUP BY song_id HAVING count(*) % 2 = 1""",
    "playlist_replaced": """, p AS (SELECT 'list ' || label AS name, song_id AS position FROM tracks WHERE label NOT IN (1, 2) UNION ALL SELECT 'list 1', song_id // 17 FROM favs)
SELECT name, count(*) AS songs, max(position) AS last FROM p GROUP BY name""",
    "queue_edits": """, q AS (SELECT label, list(song_id ORDER BY song_id) AS q FROM tracks GROUP BY label)
SELECT label, array_to_string(q[1:2] || q[4:], ',') AS removed, array_to_string([q[1]] || q[3:5] || [q[2]] || q[6:], ',') AS moved,
 array_to_string(q[1:3] || [-7] || q[4:], ',') AS inserted, array_to_string(q || [-9], ',') AS appended FROM q""",
    "remembered_days": """, d AS (SELECT '2024-01-1' || label AS day, count(*) AS n FROM tracks GROUP BY label)
SELECT day, (CASE WHEN day = '2024-01-15' THEN least(2, n) ELSE n END)::INTEGER AS songs FROM d ORDER BY day DESC LIMIT 7""",
    "act_parsing": "SELECT song_id, act, song, display, duplicate_key FROM keyed",
    "day_and_clock": """SELECT id, strftime(make_timestamp(played_at * 1000), '%Y-%m-%d') AS day, greatest(1000, 86400000 - played_at % 86400000) AS until_midnight,
 lpad((played_ms // 1000 // 60)::VARCHAR, 2, '0') || ':' || lpad((played_ms // 1000 % 60)::VARCHAR, 2, '0') AS clock FROM listens""",
    "cosine_guard": f"""SELECT t.song_id, CASE WHEN t.song_id % 10 = 0 THEN 0.0::DOUBLE ELSE round({_COS}, 6) END AS score,
 CASE WHEN t.song_id % 10 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS length FROM tracks t, tracks q WHERE q.song_id = 1""",
    "mix_anchors": "SELECT song_id, round(draw, 6) AS draw FROM anchors",
    "mix_shortlist": """, s AS (SELECT p.song_id, max(list_dot_product(p.vector, a.vector)) + 0.15::DOUBLE * least(1.0::DOUBLE, greatest(-1.0::DOUBLE, any_value(p.weight))) AS score FROM pool p, anchors a GROUP BY p.song_id)
SELECT song_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, song_id LIMIT 100""",
    "playlist_reuse": "SELECT (SELECT count(*) FROM favs JOIN songs USING (song_id)) >= (SELECT count(*) + 1 FROM favs) - 2 AND (SELECT count(*) FROM favs) > 0 AS keep",
    "wave_start": "SELECT unnest(range(len(direction)))::INTEGER AS pos, round(unnest(direction), 6) AS x FROM dirn",
    "wave_scores": "SELECT song_id, round(score, 6) AS score FROM wscore",
    "wave_draw": """, b AS (SELECT * FROM wscore ORDER BY score DESC, song_id LIMIT 40)
SELECT song_id, round(score, 6) AS score FROM b ORDER BY b.score / 0.12::DOUBLE - ln(-ln((('0x' || substr(md5('42:' || song_id), 1, 8))::UBIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)) DESC, song_id LIMIT 1""",
    "wave_reaction": """, a0 AS (SELECT list_transform(range(1, len(d.direction) + 1), lambda i: d.direction[i] + 0.15::DOUBLE * l.u[i]) AS v FROM dirn d, (SELECT u FROM own WHERE song_id = 5) l),
 a1 AS (SELECT list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM a0),
 b0 AS (SELECT list_transform(range(1, len(a1.v) + 1), lambda i: a1.v[i] - 0.1::DOUBLE * s.u[i]) AS v FROM a1, (SELECT u FROM own WHERE song_id = 6) s),
 b1 AS (SELECT list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM b0)
SELECT unnest(range(len(v)))::INTEGER AS pos, round(unnest(v), 6) AS x FROM b1""",
    "fidelity_report": """, c AS (SELECT vector, list_transform(vector, lambda x: round(x * 8) / 8) AS coarse FROM tracks),
 s AS (SELECT CASE WHEN list_dot_product(coarse, coarse) > 0 THEN list_cosine_similarity(vector, coarse) ELSE 0.0::DOUBLE END AS s FROM c)
SELECT round(min(s), 6) AS worst, round(avg(s), 6) AS mean FROM s""",
    "alignment_report": f"SELECT label_idx, round(max({_COS}), 6) AS peak, round(avg({_COS}), 6) AS mean, round(stddev_pop({_COS}), 6) AS deviation FROM tracks t, labelv q GROUP BY label_idx",
    "tracked_departures": "SELECT listener, count(*) AS departures, sum(played_ms)::BIGINT AS played_ms, sum(duration_ms)::BIGINT AS duration_ms FROM plays GROUP BY listener",
}
_BODIES |= {
    "wave_seeds": """, likes AS (SELECT pos, sum(weight * x) AS x FROM weights JOIN flat USING (song_id) WHERE weight > 0 GROUP BY pos)
SELECT 'similar' AS mode, pos::INTEGER AS pos, round(x, 6) AS x FROM flat WHERE song_id = 7
UNION ALL SELECT 'random', pos::INTEGER, round(x, 6) FROM flat WHERE song_id = (SELECT song_id FROM tracks ORDER BY ('0x' || substr(md5('42:' || song_id), 1, 8))::UBIGINT, song_id LIMIT 1)
UNION ALL SELECT 'taste', (pos)::INTEGER, round(x, 6) FROM likes""",
    "preferences_import": """, p AS (
 SELECT 'favourites' AS kind, NULL AS name, label, song_id FROM tracks WHERE song_id % 17 = 0
 UNION ALL SELECT 'dislikes', NULL, label, song_id FROM tracks WHERE song_id % 19 = 0
 UNION ALL SELECT 'playlists', 'list ' || label, label, song_id FROM tracks WHERE song_id % 23 = 0)
SELECT kind, name, (row_number() OVER (PARTITION BY kind, label ORDER BY song_id) - 1)::INTEGER AS position, song_id FROM p WHERE label <> 1
UNION ALL SELECT 'queue', NULL, position, song_id FROM (SELECT DISTINCT label FROM tracks WHERE label <> 1), (VALUES (0, 3), (1, 1), (2, 3)) q(position, song_id)""",
    "player_departures": """, d AS (SELECT listener, CASE WHEN id % 4 = 0 THEN id * 1000 + 3 ELSE lead(id) OVER (PARTITION BY listener ORDER BY id) * 1000 END AS left_at, song_id,
 greatest(0, played_ms, CASE WHEN id % 4 = 0 THEN duration_ms ELSE 0 END) AS played_ms, duration_ms FROM plays)
SELECT listener, left_at, song_id, played_ms, duration_ms FROM d WHERE left_at IS NOT NULL""",
    "plays_debounced": """, n AS (SELECT *, lead(played_at) OVER (PARTITION BY listener ORDER BY played_at, id) AS after FROM plays)
SELECT listener, id, song_id FROM n WHERE after IS NULL OR after - played_at >= 3600000""",
    "plays_throttled": "SELECT listener, id, song_id FROM plays QUALIFY row_number() OVER (PARTITION BY listener, played_at // 21600000 ORDER BY played_at DESC, id DESC) = 1",
    "playlist_days": "SELECT listener, strftime(make_timestamp(played_at * 1000), '%Y-%m-%d') AS day, min(played_at) AS at FROM plays GROUP BY ALL",
    "live_folders": "SELECT folder, count(*) AS analysed FROM songs JOIN tracks USING (song_id) WHERE song_id % 3 <> 0 GROUP BY folder",
}

#: Density clusters by a recursive query: labels spread over links of cores until nothing changes.
_BODIES["density_clusters"] = """, pr AS MATERIALIZED (SELECT t.song_id AS a, q.song_id AS b FROM tracks t JOIN tracks q ON t.song_id <> q.song_id AND 1 - list_dot_product(t.vector, q.vector) <= 0.68),
 core AS MATERIALIZED (SELECT a AS id FROM pr GROUP BY a HAVING count(*) + 1 >= 3),
 cc AS MATERIALIZED (SELECT a, b FROM pr WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
 reach(id, root) AS (SELECT id, id FROM core UNION SELECT cc.b, r.root FROM reach r JOIN cc ON cc.a = r.id WHERE r.root < cc.b),
 comp AS (SELECT id, min(root) AS c FROM reach GROUP BY id),
 brd AS (SELECT pr.a AS id, min(c) AS c FROM pr JOIN comp ON comp.id = pr.b WHERE pr.a NOT IN (SELECT id FROM core) GROUP BY pr.a)
SELECT song_id, coalesce(comp.c, brd.c, -1) AS cluster FROM tracks LEFT JOIN comp ON comp.id = song_id LEFT JOIN brd ON brd.id = song_id"""

_SWEPT = """, radii(step, eps) AS (VALUES (0, 0.55::DOUBLE), (1, 0.6::DOUBLE), (2, 0.63::DOUBLE), (3, 0.66::DOUBLE), (4, 0.68::DOUBLE), (5, 0.7::DOUBLE)),
 pr AS MATERIALIZED (SELECT step, t.song_id AS a, q.song_id AS b FROM tracks t JOIN tracks q ON t.song_id <> q.song_id JOIN radii ON 1 - list_dot_product(t.vector, q.vector) <= eps),
 core AS MATERIALIZED (SELECT step, a AS id FROM pr GROUP BY step, a HAVING count(*) + 1 >= 3),
 cc AS MATERIALIZED (SELECT pr.step, pr.a, pr.b FROM pr JOIN core x ON x.step = pr.step AND x.id = pr.a JOIN core y ON y.step = pr.step AND y.id = pr.b),
 reach(step, id, root) AS (SELECT step, id, id FROM core UNION SELECT r.step, cc.b, r.root FROM reach r JOIN cc ON cc.step = r.step AND cc.a = r.id WHERE r.root < cc.b),
 comp AS (SELECT step, id, min(root) AS c FROM reach GROUP BY step, id),
 brd AS (SELECT pr.step, pr.a AS id, min(c) AS c FROM pr JOIN comp ON comp.step = pr.step AND comp.id = pr.b LEFT JOIN core ON core.step = pr.step AND core.id = pr.a WHERE core.id IS NULL GROUP BY pr.step, pr.a),
 swept AS (SELECT step, id AS song_id, c AS cluster FROM comp UNION ALL SELECT step, id, c FROM brd)
"""
_BODIES["density_sweep"] = _SWEPT + "SELECT step, song_id, cluster FROM swept"
_BODIES["sweep_coverage"] = _SWEPT + """SELECT step, coalesce(sum(n) FILTER (WHERE n BETWEEN 3 AND 60), 0)::BIGINT AS covered, max(n) AS largest
FROM (SELECT step, cluster, count(*) AS n FROM swept GROUP BY step, cluster) GROUP BY step"""
_BODIES["migrated_vectors"] = """SELECT song_id, (song_id % 4 + 1)::INTEGER AS version, len(vector)::INTEGER AS dims, round(list_sum(vector), 6) AS total,
       CASE WHEN song_id % 4 >= 2 THEN (SELECT count(*) FROM plays) ELSE 0 END AS listens FROM tracks"""
_BODIES["routed_texts"] = """, tx AS (SELECT song_id, lower(CASE WHEN song_id % 7 = 0 THEN title || ' ё' WHEN song_id % 7 <> 1 THEN title END) AS t FROM songs),
 raw2 AS (SELECT song_id, t IS NULL OR contains(t, 'x') AS lost, CASE WHEN song_id % 7 = 0 THEN [length(o), length(o) - length(replace(o, ' ', '')), 1]::DOUBLE[]
   ELSE [length(o) - length(replace(o, 'a', '')), length(o) - length(replace(o, 'e', '')), length(o) - length(replace(o, 'o', ''))]::DOUBLE[] END AS v FROM (SELECT *, coalesce(t, '') AS o FROM tx)),
 un AS (SELECT song_id, lost, v, sqrt(list_dot_product(v, v)) AS n FROM raw2)
SELECT song_id, round((CASE WHEN lost THEN NULL WHEN n > 0 THEN v[1] / n ELSE v[1] END)::FLOAT::DOUBLE, 5) AS v0, round((CASE WHEN lost THEN NULL WHEN n > 0 THEN v[2] / n ELSE v[2] END)::FLOAT::DOUBLE, 5) AS v1, round((CASE WHEN lost THEN NULL WHEN n > 0 THEN v[3] / n ELSE v[3] END)::FLOAT::DOUBLE, 5) AS v2 FROM un"""
_SLOT = "CASE WHEN hour(epoch_ms({0})) < 5 THEN 'night' WHEN hour(epoch_ms({0})) < 12 THEN 'morning' WHEN hour(epoch_ms({0})) < 18 THEN 'day' ELSE 'evening' END"
_BODIES["days_foretell"] = f""", l AS (SELECT l.id, l.listener, {_SLOT.format("l.played_at")} AS slot, epoch_ms(l.played_at)::DATE AS day, t.vector FROM listens l JOIN tracks t USING (song_id)),
 fl AS (SELECT listener, slot, day, unnest(vector) AS x, unnest(range(len(vector))) AS pos FROM l),
 sd AS (SELECT listener, slot, day, pos, sum(x) AS x, count(*) AS n FROM fl GROUP BY ALL),
 pr AS (
  SELECT listener, slot, day, pos, sum(x) OVER (PARTITION BY listener, slot, pos) - x AS own, sum(n) OVER (PARTITION BY listener, slot, pos) - n AS more,
         sum(x) OVER (PARTITION BY listener, pos) - sum(x) OVER (PARTITION BY listener, day, pos) AS every
  FROM sd),
 pv AS (SELECT listener, slot, day, list(own ORDER BY pos) AS own, list(every ORDER BY pos) AS every FROM pr WHERE more > 0 GROUP BY listener, slot, day),
 c AS (SELECT slot, list_cosine_similarity(vector, own) AS same, list_cosine_similarity(vector, every) AS every FROM l JOIN pv USING (listener, slot, day))
SELECT slot, count(*) AS n, round(avg(same), 6) AS same, round(avg(every), 6) AS any_slot, round(avg(CASE WHEN same > every + 1e-12 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS wins FROM c GROUP BY slot"""
_BODIES["sitting_slots"] = f""", g AS (SELECT *, coalesce(played_at - lag(played_at) OVER (PARTITION BY listener ORDER BY played_at, id) > 1800000, true) AS apart FROM listens),
 n AS (SELECT *, sum(apart::INTEGER) OVER (PARTITION BY listener ORDER BY played_at, id ROWS UNBOUNDED PRECEDING) AS sitting FROM g),
 s AS (SELECT listener, sitting, min(played_at) AS begun, count(*) FILTER (WHERE song_id IN (SELECT song_id FROM tracks)) AS heard FROM n GROUP BY listener, sitting)
SELECT {_SLOT.format("begun")} AS slot, count(*) AS sittings, sum(heard)::BIGINT AS listens FROM s WHERE heard > 0 GROUP BY ALL"""
_BODIES["pair_quantiles"] = """, d AS (
  SELECT t.label::BIGINT AS grp, 1 - list_dot_product(t.vector, q.vector) AS eps, row_number() OVER (PARTITION BY t.label ORDER BY 1 - list_dot_product(t.vector, q.vector)) - 1 AS place, count(*) OVER (PARTITION BY t.label) AS m
  FROM tracks t JOIN tracks q ON t.label = q.label AND t.song_id < q.song_id),
 k AS (SELECT range::INTEGER AS step, 0.001::DOUBLE + 0.149::DOUBLE * range / 8 AS q FROM range(9))
SELECT grp, step, round(eps, 6) AS eps FROM d JOIN k ON place = floor(q * (m - 1))"""
_BODIES["presented_albums"] = """, m AS (SELECT song_id, display, min(song_id) OVER (PARTITION BY coalesce(display, '?')) AS cluster FROM acts),
 al AS (
  SELECT cluster, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, cluster) AS place, sha256(string_agg(song_id::VARCHAR, ',' ORDER BY song_id)) AS album_id
  FROM m GROUP BY cluster),
 per AS (SELECT cluster, display AS artist, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, min(song_id)) AS rnk FROM m WHERE display IS NOT NULL GROUP BY cluster, display),
 lead AS (SELECT cluster, string_agg(artist, ', ' ORDER BY rnk) FILTER (WHERE rnk <= 3) AS subtitle FROM per GROUP BY cluster),
 base AS (
  SELECT al.*, CASE al.cluster % 3 WHEN 0 THEN 'Calm' WHEN 1 THEN 'Loud' ELSE 'Mix ' || place END AS title, per.artist, lead.subtitle
  FROM al LEFT JOIN per ON per.cluster = al.cluster AND rnk = 1 AND 2 * n >= size LEFT JOIN lead ON lead.cluster = al.cluster),
 greedy(place, name, used) AS (
  SELECT 0::BIGINT, ''::VARCHAR, []::VARCHAR[]
  UNION ALL
  SELECT place, name, list_append(used, name) FROM (
   SELECT b.place, r.used,
          CASE WHEN NOT list_contains(used, title) THEN title
               WHEN artist IS NOT NULL AND NOT list_contains(used, title || ' · ' || artist) THEN title || ' · ' || artist
               ELSE title || ' ' || list_filter(range(2, len(used) + 3), lambda n: NOT list_contains(used, title || ' ' || n))[1] END AS name
   FROM greedy r JOIN base b ON b.place = r.place + 1))
SELECT b.place::INTEGER AS place, b.album_id, r.name AS title, coalesce(b.subtitle, '') AS subtitle, b.size FROM base b JOIN greedy r USING (place)"""

#: The greedy choice, a pick or a raised quota each round, and then the tour, as recursions over the shortlist.
_BODIES["daily_mix"] = """, anchored AS (SELECT p.song_id, max(list_dot_product(p.vector, a.vector)) + 0.15::DOUBLE * least(1.0::DOUBLE, greatest(-1.0::DOUBLE, any_value(p.weight))) AS score FROM pool p, anchors a GROUP BY p.song_id),
 short AS (
  SELECT p.song_id, p.vector, s.score, coalesce(p.grp, '') AS grp, coalesce(p.duplicate_key, '') AS dkey,
         p.last_played IS NULL OR 1706659200000 - p.last_played > 30 * 86400000::BIGINT AS fresh, row_number() OVER (ORDER BY s.score DESC, p.song_id) AS rk
  FROM anchored s JOIN pool p USING (song_id) QUALIFY rk <= 300),
 greedy(turn, song_id, vector, score, grp, dkey, fresh, rk, nearest, picked, quota) AS (
  SELECT 0, song_id, vector, score, grp, dkey, fresh, rk, NULL::DOUBLE, NULL::BIGINT, (SELECT greatest(2, ceil(28.0::DOUBLE / count(DISTINCT grp))::BIGINT) FROM short) FROM short
  UNION ALL
  SELECT turn + 1, song_id, vector, score, grp, dkey, fresh, rk,
         CASE WHEN can THEN greatest(coalesce(nearest, -2.0::DOUBLE), list_dot_product(vector, best)) ELSE nearest END,
         CASE WHEN can AND place = 1 THEN done ELSE picked END, CASE WHEN can THEN quota ELSE quota + 1 END
  FROM (
   SELECT *, bool_or(within) OVER () AS can, row_number() OVER (ORDER BY within DESC, worth DESC, rk) AS place, first_value(vector) OVER (ORDER BY within DESC, worth DESC, rk) AS best
   FROM (
    SELECT *, free AND used < quota AS within, bool_or(free) OVER () AS any_free
    FROM (
     SELECT *, picked IS NULL AND coalesce(nearest, -2.0::DOUBLE) <= 0.99 AND (dkey = '' OR same = 0) AND (fresh OR 28 - done > 11 - done_fresh) AS free, 0.75::DOUBLE * score - 0.25::DOUBLE * coalesce(nearest, 0.0::DOUBLE) AS worth
     FROM (
      SELECT *, count(picked) OVER () AS done, count(picked) FILTER (WHERE fresh) OVER () AS done_fresh, count(picked) OVER (PARTITION BY grp) AS used, count(picked) OVER (PARTITION BY dkey) AS same
      FROM greedy)))
   WHERE done < 28 AND any_free)),
 chosen AS (SELECT song_id, vector, picked FROM greedy WHERE turn = (SELECT max(turn) FROM greedy) AND picked IS NOT NULL),
 typical AS (SELECT a.song_id, a.picked, sum(list_dot_product(a.vector, b.vector)) AS total FROM chosen a, chosen b GROUP BY a.song_id, a.picked),
 first AS (SELECT CASE WHEN (SELECT count(*) FROM chosen) <= 2 THEN (SELECT song_id FROM chosen WHERE picked = 0) ELSE (SELECT song_id FROM typical ORDER BY total, picked LIMIT 1) END AS song_id),
 walk(turn, song_id, vector, picked, stop, here) AS (
  SELECT 0, c.song_id, c.vector, c.picked, CASE WHEN c.song_id = f.song_id THEN 0 END, v.vector FROM chosen c, first f, chosen v WHERE v.song_id = f.song_id
  UNION ALL
  SELECT turn + 1, song_id, vector, picked, CASE WHEN stop IS NULL AND place = 1 THEN turn + 1 ELSE stop END, there
  FROM (
   SELECT *, row_number() OVER (ORDER BY stop IS NOT NULL, list_dot_product(vector, here) DESC, picked) AS place,
          first_value(vector) OVER (ORDER BY stop IS NOT NULL, list_dot_product(vector, here) DESC, picked) AS there, bool_or(stop IS NULL) OVER () AS left_over
   FROM walk)
  WHERE left_over)
SELECT stop::BIGINT AS position, song_id FROM walk WHERE turn = (SELECT max(turn) FROM walk)"""

_BODIES |= {
    "albums_files": "SELECT 's0' AS signature, label, song_id FROM tracks WHERE label < 3 UNION ALL SELECT 's1', label, song_id FROM tracks",
    "cleared_stores": """SELECT 'vectors' AS store, (SELECT count(*) FROM tracks) AS before, 0::BIGINT AS cleared, (SELECT count(*) FROM tracks WHERE song_id % 2 = 0) AS after, (SELECT count(*) FROM tracks WHERE song_id % 2 = 0) AS analysed
UNION ALL SELECT 'listens', (SELECT count(*) FROM listens), 0, (SELECT count(*) FROM listens WHERE id % 3 = 0), NULL""",
    "stored_sessions": """, l AS (SELECT listener, song_id AS last, played_at AS saved_at FROM listens QUALIFY row_number() OVER (PARTITION BY listener ORDER BY played_at DESC, id DESC) = 1),
 p AS (SELECT l.listener, list_sort(list(DISTINCT s.song_id)) AS played FROM l JOIN listens s USING (listener) WHERE saved_at - s.played_at < 86400000 GROUP BY l.listener)
SELECT listener, CASE listener % 4 WHEN 0 THEN 'similar' WHEN 1 THEN 'description' WHEN 2 THEN 'taste' ELSE 'radio' END AS mode, CASE WHEN listener % 4 = 1 THEN 'ночь ' || listener END AS description,
 len(played)::INTEGER AS songs, len(played)::INTEGER AS steps, (listener % 3)::INTEGER AS rejections, 'a,б' AS recent, listener % 2 = 0 AS avoids, round(vector[1], 6) AS first, round(list_sum(list_transform(vector, lambda x: x * 0.5::DOUBLE)), 6) AS centre,
 listener % 4 < 3 AND listener % 5 <> 0 AND 1706659200000 - 3600000 - saved_at <= 12 * 3600000::BIGINT AS resumes
FROM l JOIN p USING (listener) JOIN tracks ON song_id = last WHERE listener % 7 <> 0 AND listener % 11 <> 0""",
    "titles_in_pairs": """, one AS (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz0123456789', '')) AS c),
 joined AS (SELECT a.c AS a, b.c AS b, row_number() OVER (ORDER BY (13 * unicode(a.c) + 29 * unicode(b.c)) % 101, a.c, b.c) AS r FROM (SELECT c FROM one UNION ALL SELECT 'Ġ') a, one b WHERE (7 * unicode(a.c) + 11 * unicode(b.c)) % 5 < 3),
 tokens AS (
  SELECT c AS t, row_number() OVER (ORDER BY o) + 3 AS id FROM (SELECT c, 4 + row_number() OVER () AS o FROM one UNION ALL SELECT * FROM (VALUES ('Ġ', 0), ('#', 1), ('B', 2), ('-', 3))) WHERE c NOT IN ('q', 'x', '7')
  UNION ALL SELECT a || b, (SELECT 4 + count(*) + 4 - 3 FROM one) - 1 + row_number() OVER (ORDER BY r) FROM joined WHERE b <> 't'),
 m AS (SELECT map(list(a || ' ' || b ORDER BY r), list(r ORDER BY r)) AS ranks, list(a ORDER BY r) AS lefts, list(b ORDER BY r) AS rights FROM joined),
 v AS (SELECT map(list(t), list(id)) AS ids FROM tokens),
 cut AS (SELECT song_id, regexp_extract_all(title, ' ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+') AS ws FROM songs),
 merge(w, parts, turn) AS (
  SELECT w, string_split(w, ''), 0 FROM (SELECT DISTINCT replace(unnest(ws), ' ', 'Ġ') AS w FROM cut)
  UNION ALL
  SELECT w, list_reduce(list_transform(parts, lambda p: [p]), lambda acc, x: CASE WHEN acc[-1] = lefts[best] AND x[1] = rights[best] THEN list_concat(acc[1:len(acc) - 1], [lefts[best] || rights[best]]) ELSE list_concat(acc, x) END), turn + 1
  FROM (SELECT w, parts, turn, lefts, rights, list_min(list_transform(range(1, len(parts)), lambda i: map_extract(ranks, parts[i] || ' ' || parts[i + 1])[1])) AS best FROM merge, m) WHERE best IS NOT NULL),
 done AS (SELECT w, list_transform(arg_max(parts, turn), lambda p: coalesce(map_extract(any_value(ids), p)[1], 3)) AS ids FROM merge, v GROUP BY w),
 flat_words AS (SELECT song_id, replace(unnest(ws), ' ', 'Ġ') AS w, unnest(range(len(ws))) AS k FROM cut)
SELECT song_id, array_to_string(list_concat([0], list_concat(flatten(list(ids ORDER BY k)), [2])), ',') AS ids FROM flat_words JOIN done USING (w) GROUP BY song_id""",
    "titles_in_pieces": """, one AS (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz0123456789', '')) AS c, unnest(range(36)) AS o),
 two AS (SELECT a.c || b.c AS t, row_number() OVER (ORDER BY a.o, b.o) AS o FROM one a, one b WHERE (5 * unicode(a.c) + 3 * unicode(b.c)) % 7 < 3),
 vocab AS (SELECT t, row_number() OVER (ORDER BY part, o) + 2 AS id FROM (
  SELECT c AS t, 0 AS part, o FROM one WHERE c NOT IN ('z', '9') UNION ALL SELECT '#', 1, 0 UNION ALL SELECT t, 2, o FROM two
  UNION ALL SELECT '##' || c, 3, o FROM one WHERE c NOT IN ('g', 'k', '8') UNION ALL SELECT '##' || t, 4, o FROM two)),
 v AS (SELECT map(list(t), list(id)) AS ids FROM vocab),
 cut AS (SELECT song_id, regexp_extract_all(lower(title), '[a-z0-9]+|[^a-z0-9\\s]') AS ws FROM songs),
 greedy(w, here, pieces) AS (
  SELECT w, 0, []::BIGINT[] FROM (SELECT DISTINCT unnest(ws) AS w FROM cut)
  UNION ALL
  SELECT w, CASE WHEN two IS NOT NULL THEN here + 2 WHEN single IS NOT NULL THEN here + 1 ELSE length(w) + 1 END, CASE WHEN coalesce(two, single) IS NULL THEN [0] ELSE list_append(pieces, coalesce(two, single)) END
  FROM (SELECT w, here, pieces, CASE WHEN here + 2 <= length(w) THEN map_extract(ids, (CASE WHEN here > 0 THEN '##' ELSE '' END) || substr(w, here + 1, 2))[1] END AS two,
               map_extract(ids, (CASE WHEN here > 0 THEN '##' ELSE '' END) || substr(w, here + 1, 1))[1] AS single FROM greedy, v WHERE here < length(w))),
 flat_words AS (SELECT song_id, unnest(ws) AS w, unnest(range(len(ws))) AS k FROM cut)
SELECT song_id, array_to_string(list_concat([1], list_concat(flatten(list(pieces ORDER BY k)), [2])), ',') AS ids FROM flat_words JOIN (SELECT * FROM greedy WHERE here >= length(w)) USING (w) GROUP BY song_id""",
    "resampled_sounds": """, p AS (SELECT song_id, list_transform(range(1, len(vector) // 2 + 1), lambda i: (floor(vector[2 * i - 1] * 30000) + floor(vector[2 * i] * 30000)) / 2::DOUBLE / 32768::DOUBLE) AS x FROM tracks),
 a AS (SELECT song_id, x, list_transform(range(floor(len(x) * 48000 / 44100)::BIGINT), lambda k: k * 44100 / 48000::DOUBLE) AS here FROM p),
 s AS (SELECT song_id, list_transform(here, lambda t: x[floor(t)::BIGINT + 1] + (t - floor(t)) * (x[least(floor(t)::BIGINT + 2, len(x))] - x[floor(t)::BIGINT + 1])) AS y FROM a)
SELECT song_id, len(y)::INTEGER AS n, round(list_sum(y), 6) AS total, round(y[18], 6) AS inner, round(y[-1], 6) AS last FROM s""",
    "dominant_acts": """, b AS (SELECT *, folder || '/' || substr(coalesce(display, 'Brand#' || (song_id % 9 + 1)), 1, 7) AS cluster FROM acts),
 n AS (SELECT cluster, display, count(*) AS n, min(song_id) AS f FROM b WHERE display IS NOT NULL GROUP BY ALL), z AS (SELECT cluster, count(*) AS size FROM b GROUP BY cluster),
 r AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, f) = 1)
SELECT cluster, display AS artist FROM r JOIN z USING (cluster) WHERE 2 * n >= size""",
    "positions_sampled": """, st AS (
  SELECT listener, played_at AS ts, song_id, CASE WHEN id % 3 = 0 THEN duration_ms // 2 ELSE 0 END AS position, CASE WHEN id % 4 > 0 THEN duration_ms ELSE 0 END AS len, true AS playing FROM plays
  UNION ALL SELECT listener, played_at + played_ms, song_id, 0, duration_ms, false FROM plays),
 sp AS (SELECT *, lead(ts) OVER (PARTITION BY listener ORDER BY ts, playing, song_id) - ts AS span FROM st),
 n AS (SELECT *, greatest(0, least((span - 1) // 500, CASE WHEN len > 0 THEN (len - position) // 500 END)) AS n FROM sp WHERE playing AND span IS NOT NULL AND span > 0)
SELECT listener, song_id, sum(n)::BIGINT AS samples, max(position + n * 500)::BIGINT AS furthest, max(ts + n * 500)::BIGINT AS last FROM n WHERE n > 0 GROUP BY listener, song_id""",
    "readable_covers": """, k AS (SELECT song_id, (song_id * 2654435) % 16777216 AS rgb, least(song_id * 7 % 101, song_id * 13 % 101) / 100.0::DOUBLE AS dark, greatest(song_id * 7 % 101, song_id * 13 % 101) / 100.0::DOUBLE AS bright, (song_id % 5) / 4.0::DOUBLE AS alpha FROM tracks),
 parts AS (SELECT song_id, unnest([0.2126::DOUBLE, 0.7152::DOUBLE, 0.0722::DOUBLE]) AS w, unnest([rgb // 65536, rgb // 256 % 256, rgb % 256]) / 255.0::DOUBLE AS g FROM k),
 theme AS (SELECT song_id, sum(w * CASE WHEN g <= 0.03928 THEN g / 12.92::DOUBLE ELSE pow((g + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END) AS theme FROM parts GROUP BY song_id),
 greys AS (SELECT k.*, theme, list_transform([theme, dark, bright], lambda l: CASE WHEN l <= 0.0031308 THEN l * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow(l, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END) AS g FROM k JOIN theme USING (song_id)),
 tried AS (SELECT song_id, s / 100.0::DOUBLE AS s, list_transform([g[2], g[3]], lambda i: (g[1] * (1 - alpha) + i * alpha) * (1 - s / 100.0::DOUBLE) + g[1] * s / 100.0::DOUBLE) AS b FROM greys, (SELECT unnest(range(0, 88, 2)) AS s)),
 lum AS (SELECT song_id, s, list_transform(b, lambda v: CASE WHEN v <= 0.03928 THEN v / 12.92::DOUBLE ELSE pow((v + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END) AS l FROM tried),
 need AS (SELECT song_id, min(s) AS s FROM lum WHERE greatest((list_min(l) + 0.05::DOUBLE) / 0.05::DOUBLE, 1.05::DOUBLE / (list_max(l) + 0.05::DOUBLE)) >= 4.5 GROUP BY song_id)
SELECT song_id, round(theme, 6) AS luminance, round(1.05::DOUBLE / (theme + 0.05::DOUBLE), 6) AS on_white, round(greatest((dark + 0.05::DOUBLE) / 0.05::DOUBLE, 1.05::DOUBLE / (bright + 0.05::DOUBLE)), 6) AS best,
 round(CASE WHEN alpha <= 0 THEN 0.0::DOUBLE ELSE coalesce(s, 0.88::DOUBLE) END, 6) AS scrim FROM greys LEFT JOIN need USING (song_id)""",
}
#: Exact and coarse ranks of every hundredth track, and what becomes of its nearest.
_FIDELITY = """, c AS (SELECT song_id, vector, list_transform(vector, lambda x: round(x * 8) / 8) AS coarse FROM tracks),
 r AS (SELECT q.song_id AS query_id, t.song_id, row_number() OVER (PARTITION BY q.song_id ORDER BY list_dot_product(t.vector, q.vector) DESC, t.song_id) AS a,
              row_number() OVER (PARTITION BY q.song_id ORDER BY list_dot_product(t.coarse, q.coarse) DESC, t.song_id) AS b FROM c t, c q WHERE q.song_id % 100 = 0 AND t.song_id <> q.song_id),
 f AS (SELECT query_id, count(*) FILTER (WHERE a <= 1 AND b <= 1) AS shared_1, count(*) FILTER (WHERE a <= 5 AND b <= 5) AS shared_5, count(*) FILTER (WHERE a <= 10 AND b <= 10) AS shared_10, (min(b) FILTER (WHERE a = 1)) - 1 AS place FROM r GROUP BY query_id),
 w AS (SELECT f.*, CASE WHEN list_dot_product(coarse, coarse) > 0 THEN list_cosine_similarity(vector, coarse) ELSE 0.0::DOUBLE END AS own FROM f JOIN c ON song_id = query_id)
"""
_BODIES |= {
    "model_fidelity": _FIDELITY + "SELECT query_id, round(own, 6) AS own, shared_1, shared_5, shared_10, place FROM w",
    "model_agreement": _FIDELITY + "SELECT round(min(own), 6) AS own_least, round(avg(own), 6) AS own_mean, round(avg(shared_1), 6) AS top_1, round(avg(shared_5) / 5, 6) AS top_5, round(avg(shared_10) / 10, 6) AS top_10, round(avg(place), 6) AS place_mean, max(place) AS place_worst FROM w",
}


def _whole(body: str) -> str:
    prelude = PRELUDE.replace("WITH raw", "WITH RECURSIVE raw", 1) if any(f" {name}(" in body for name in ("reach", "greedy", "merge")) else PRELUDE
    return prelude.rstrip() + ("" if body.startswith(",") else "\n") + body


ORACLE_SQL: dict[str, str] = {name: _whole(body) for name, body in _BODIES.items()}
