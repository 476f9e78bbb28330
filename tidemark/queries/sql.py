"""Shared common table expressions of the SQL counterparts."""

IV = """iv AS (
  SELECT user_id AS video_id, event_id, event_type, value,
         epoch_us(ts) // 1000 AS start_ms,
         epoch_us(ts) // 1000 + CAST(floor(value * 100000) AS BIGINT) + 1 AS end_ms,
         CASE event_type WHEN 'view' THEN 'visual_description' WHEN 'click' THEN 'ocr' ELSE 'transcript' END AS modality
  FROM events)"""


def merged(source: str, name: str, gap: int = 0, keys: str = "video_id") -> str:
    """CTEs that merge the ranges of ``source`` into ``name``."""
    return f"""{name}_r AS (
  SELECT {keys}, start_ms, end_ms,
         max(end_ms) OVER (PARTITION BY {keys} ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM {source}),
{name}_i AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach + {gap} THEN 1 ELSE 0 END)
         OVER (PARTITION BY {keys} ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island
  FROM {name}_r),
{name} AS (
  SELECT {keys}, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_ranges
  FROM {name}_i GROUP BY {keys}, island)"""


SEGS = """segs AS (
  SELECT conv_id AS video_id, turn AS ord, concat_ws('_', 'seg', conv_id, turn) AS segment_id,
         turn * 5000 AS start_ms, turn * 5000 + 2200 + length(text) % 2600 AS end_ms,
         trim(regexp_replace(text, '\\s+', ' ', 'g')) AS seg_text, role, text AS raw_text
  FROM conversations)"""

LINES = """raw_lines AS (
  SELECT doc_id AS video_id, lang AS language, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM documents),
segs AS (
  SELECT video_id, line_no AS ord, concat_ws('_', 'line', video_id, line_no) AS segment_id,
         line_no * 4000 + CASE WHEN line_no % 7 = 6 THEN 3500 ELSE 0 END AS start_ms,
         line_no * 4000 + CASE WHEN line_no % 7 = 6 THEN 3500 ELSE 0 END + 1500 + length(line) % 2300 AS end_ms,
         trim(regexp_replace(line, '\\s+', ' ', 'g')) AS seg_text, language
  FROM raw_lines
  WHERE trim(regexp_replace(line, '\\s+', ' ', 'g')) <> '')"""


def chunk_fold(target_ms: int, max_ms: int, target_chars: int, max_chars: int, gap_ms: int) -> str:
    """Recursive CTEs from ``segs`` to ``labelled`` (chunk_no per segment)."""
    return f"""s AS (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ord) AS rn, length(seg_text) AS chars,
         regexp_matches(seg_text, '[.!?。！？；;]["''”’）)]?$') AS fin
  FROM segs),
f AS (
  SELECT video_id, rn, ord, segment_id, start_ms, end_ms, seg_text, start_ms AS cs, CAST(chars AS BIGINT) AS cc,
         CAST(0 AS BIGINT) AS chunk_no,
         (chars >= {target_chars} OR end_ms - start_ms >= {target_ms}) AND fin AS closed
  FROM s WHERE rn = 1
  UNION ALL
  SELECT video_id, rn, ord, segment_id, start_ms, end_ms, seg_text, cs, cc, chunk_no,
         (cc >= {target_chars} OR end_ms - cs >= {target_ms}) AND fin AS closed
  FROM (
    SELECT b.video_id, b.rn, b.ord, b.segment_id, b.start_ms, b.end_ms, b.seg_text, b.fin,
           CASE WHEN brk THEN b.start_ms ELSE a_cs END AS cs,
           CASE WHEN brk THEN b.chars ELSE a_cc + b.chars END AS cc,
           CASE WHEN brk THEN a_no + 1 ELSE a_no END AS chunk_no
    FROM (
      SELECT s.*, f.cs AS a_cs, f.cc AS a_cc, f.chunk_no AS a_no,
             f.closed OR s.start_ms - f.end_ms > {gap_ms} OR f.cc + s.chars > {max_chars}
             OR s.end_ms - f.cs > {max_ms} AS brk
      FROM f JOIN s ON s.video_id = f.video_id AND s.rn = f.rn + 1) b)),
labelled AS (SELECT * FROM f)"""


CHUNKS = """chunks AS (
  SELECT video_id, chunk_no AS ord, min_by(start_ms, ord) AS start_ms, max_by(end_ms, ord) AS end_ms,
         string_agg(segment_id, ',' ORDER BY ord) AS segment_ids,
         string_agg(seg_text, ' ' ORDER BY ord) AS text
  FROM labelled GROUP BY video_id, chunk_no)"""


def grid_shots(source: str, shot_ms: int = 3000) -> str:
    return f"""shots AS (
  SELECT video_id, ord, concat_ws('_', 'shot', video_id, ord) AS shot_id,
         ord * {shot_ms} AS start_ms, (ord + 1) * {shot_ms} AS end_ms
  FROM (SELECT video_id, unnest(range(0, CAST(floor((max(end_ms) - 1) / {shot_ms}) AS BIGINT) + 1)) AS ord
        FROM {source} GROUP BY video_id))"""
