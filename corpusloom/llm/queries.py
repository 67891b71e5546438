"""The operators of this subpackage bound to the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, dialogues, jaccard, licences, lines, mixing, pages, passages, quality, secrets, sequences, vectors, whitening
from corpusloom.llm.common import documents, tokenizer_file
from corpusloom.session import materialize, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


VECTOR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS s FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id
          WHERE a.s > 0 AND b.s > 0 AND list_inner_product(a.e, b.e) >= 0.95 * a.s * b.s),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
tops AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, least(v.vec_id, coalesce(t.b, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(t.b, v.vec_id)) AS kept
FROM v LEFT JOIN counts c ON v.vec_id = c.a LEFT JOIN tops t ON v.vec_id = t.a
"""


@register(VECTOR_SQL)
def op1_cross_polytope(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.similar_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))


def _quality_sql() -> str:
    ascii_lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    kinds = ("[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", "[#*$%&|<>]", r"[!\x22\x27()+,\-./:;=?@\[\\\]^_`{}~]", r"[\x00-\x08\x0E-\x1F\x7F]", r"[\x{80}-\x{7FF}]", r"[\x{800}-\x{FFFF}]", r"[\x{10000}-\x{10FFFF}]")
    classes = ", ".join(f"length(t) - length(regexp_replace(t, '{k}', '', 'g'))" for k in kinds)
    common = ", ".join(f"('{lang}', '{w}', {i})" for lang, words in quality.COMMON_WORDS.items() for i, w in enumerate(words))
    langs = ", ".join(f"'{x}'" for x in quality.COMMON_WORDS)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({langs}) THEN lang ELSE 'und' END AS lang,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         regexp_extract_all({ascii_lower}, '[^\x20\x09-\x0D!-/:-@\[-`{{-~]+') AS h,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, g FROM windows GROUP BY doc_id, g HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM windows JOIN twice USING (doc_id, g), (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
classes AS (SELECT doc_id, lang, unnest(c) AS n, generate_subscripts(c, 1) AS bin FROM (SELECT doc_id, lang, [{classes}] AS c FROM d)),
common(lang, word, bin) AS (VALUES {common}),
found AS (SELECT doc_id, lang, unnest(h) AS word FROM d WHERE lang <> 'und'),
counted AS (SELECT f.doc_id, f.lang, coalesce(c.bin, -1) AS bin, count(*) AS n FROM found f LEFT JOIN common c USING (lang, word) GROUP BY ALL),
both_kinds AS (SELECT 'class' AS kind, doc_id, lang, bin, n FROM classes UNION ALL SELECT 'word', doc_id, lang, bin, n FROM counted),
sums AS (SELECT kind, lang, bin, sum(n) AS n FROM both_kinds GROUP BY ALL),
wholes AS (SELECT kind, lang, sum(n) AS n FROM sums GROUP BY ALL),
sizes AS (SELECT kind, doc_id, lang, sum(n) AS n FROM both_kinds GROUP BY ALL),
parts AS (
  SELECT z.kind, z.doc_id, coalesce(b.n, 0) / z.n AS p, s.n / t.n AS q
  FROM sizes z JOIN sums s ON z.kind = s.kind AND z.lang = s.lang JOIN wholes t ON z.kind = t.kind AND z.lang = t.lang
  LEFT JOIN both_kinds b ON b.kind = z.kind AND b.doc_id = z.doc_id AND b.bin = s.bin WHERE z.n > 0 AND t.n > 0),
distances AS (
  SELECT kind, doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS x
  FROM parts GROUP BY ALL),
judged AS (
  SELECT d.doc_id, c.x AS class_x, w.x AS word_x
  FROM d JOIN sizes s ON s.kind = 'class' AND s.doc_id = d.doc_id AND s.n >= {quality.MIN_CODE_POINTS}
  JOIN wholes t ON t.kind = 'class' AND t.lang = d.lang AND t.n >= {quality.MIN_REFERENCE}
  JOIN distances c ON c.kind = 'class' AND c.doc_id = d.doc_id
  LEFT JOIN sizes v ON v.kind = 'word' AND v.doc_id = d.doc_id AND v.n >= {quality.MIN_WORDS}
  LEFT JOIN distances w ON w.kind = 'word' AND w.doc_id = v.doc_id),
base AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(class_x <= {quality.MAX_CLASS_DISTANCE}, true)
         AND coalesce(word_x <= {quality.MAX_WORD_DISTANCE}, true) AS kept,
       round(class_x, 6) AS class_distance, round(word_x, 6) AS word_distance
FROM base LEFT JOIN judged USING (doc_id)
"""


@register(_quality_sql())
def op2_quality_divergence(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.quality_rules(documents(spark, sf))
    return judged.withColumn("class_distance", F.round("class_distance", 6)).withColumn("word_distance", F.round("word_distance", 6))


@register()
def op3_bpe_transducer(spark: SparkSession, sf: str) -> DataFrame:
    path = tokenizer_file("byte_bpe_50k.json")
    both = bpe.decode_documents(bpe.encode_documents(documents(spark, sf), path), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


LINE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.*, r.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@register(LINE_SQL)
def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = lines.drop_repeated_lines(documents(spark, sf))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@register()
def op7_arrow_sequences(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_path(spark, "sequences")
    written = sequences.write_sequences(documents(spark, sf), folder, tokenizer_file("word_bpe_49k.json"), end_id=1)
    found = sequences.read_documents(spark, folder, materialize(written, "manifest"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _time_sql(schedule: tuple) -> str:
    """Inverse of a schedule's integral, as ``mixing.demand_time`` has it."""
    done, out = 0.0, "CASE "
    whole = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        area, slope = (t1 - t0) * (w0 + w1) / 2, (w1 - w0) / (t1 - t0)
        left = f"(share * {whole!r}::DOUBLE - {done!r}::DOUBLE)"
        out += f"WHEN share * {whole!r}::DOUBLE <= {done + area!r}::DOUBLE THEN {t0!r} + 2 * {left} / ({w0!r} + sqrt(greatest({w0 * w0!r} + 2 * {slope!r}::DOUBLE * {left}, 0))) "
        done += area
    return f"least(greatest({out} ELSE 1 END, 0), 1)"


def _mixing_sql() -> str:
    times = " ".join(f"WHEN {i} THEN {_time_sql(x)}" for i, x in enumerate(mixing.SCHEDULES))
    weights = " ".join(f"WHEN {i} THEN {w!r}::DOUBLE" for i, w in enumerate(mixing.WEIGHTS))
    return rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '{mixing.ORDER}') AS key FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS place FROM sized GROUP BY source),
weighed AS (SELECT *, CASE place % {len(mixing.WEIGHTS)} {weights} END AS weight FROM sources),
-- sharing again and again: round by round, sources over their limit are set to it and leave
rounds AS (
  SELECT 0 AS r, source, weight, source_size, false AS full_, weight / sum(weight) OVER () * sum(source_size) OVER () AS share FROM weighed
  UNION ALL
  SELECT r + 1, source, weight, source_size, full_ OR share >= {mixing.MAX_EPOCHS} * source_size,
         CASE WHEN full_ OR share >= {mixing.MAX_EPOCHS} * source_size THEN {mixing.MAX_EPOCHS} * source_size
              ELSE weight / sum(CASE WHEN full_ OR share >= {mixing.MAX_EPOCHS} * source_size THEN 0 ELSE weight END) OVER ()
                   * (sum(source_size) OVER () - sum(CASE WHEN full_ OR share >= {mixing.MAX_EPOCHS} * source_size THEN {mixing.MAX_EPOCHS} * source_size ELSE 0 END) OVER ()) END
  FROM rounds WHERE r < 40),
targets AS (SELECT w.*, x.share AS target FROM weighed w JOIN rounds x ON x.r = 40 AND w.source IS NOT DISTINCT FROM x.source),
placed AS (
  SELECT s.*, t.source_size, t.target, t.place,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 AS middle
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
shared AS (
  SELECT *, middle / target AS share, len(list_filter(range({mixing.MAX_EPOCHS}), lambda r: middle + r * source_size <= target)) AS passes FROM placed)
SELECT doc_id, size, source_size, round(target, 3) AS target, CAST(size * passes AS BIGINT) AS taken,
       CASE WHEN passes > 0 THEN round(CASE place % {len(mixing.SCHEDULES)} {times} END, 6) END AS first_position
FROM shared
"""


@register(_mixing_sql())
def op9_curriculum_mix(spark: SparkSession, sf: str) -> DataFrame:
    placed = mixing.training_positions(documents(spark, sf))
    return placed.select(
        "doc_id",
        "size",
        "source_size",
        F.round("target", 3).alias("target"),
        (F.col("size") * F.size("positions")).alias("taken"),
        F.round(F.get("positions", F.lit(0)), 6).alias("first_position"),
    )


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS g
  FROM words),
grams AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON s.doc_id = r.a GROUP BY s.doc_id, len(s.g)
"""


@register(JACCARD_SQL)
def op8_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.similarity_classes(documents(spark, sf))


@register()
def op10_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = passages.remove_repeats(documents(spark, sf))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _licence_sql() -> str:
    listed = lambda pairs: ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    rules = [("".join(f"{s}," for s in sequence), licence) for sequence, licence in licences.RULES]
    return f"""
WITH known(id, sentence) AS (VALUES {listed(licences.SENTENCES.items())}),
rules(chain, licence) AS (VALUES {listed(rules)}),
cut AS (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '{licences.END}', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
lined AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS pos FROM cut),
plain AS (
  SELECT doc_id, pos, trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) AS s
  FROM lined WHERE regexp_matches(s, '{licences.marker_pattern()}')),
ends AS (SELECT doc_id, pos, regexp_extract(s, '{licences.known_pattern()}', 1) AS s FROM plain),
ids AS (SELECT doc_id, string_agg(k.id, ',' ORDER BY pos) AS chain FROM ends JOIN known k ON ends.s = k.sentence GROUP BY doc_id),
taken AS (
  SELECT doc_id, list_transform(regexp_extract_all(',' || replace(chain, ',', ',,') || ',', ',{licences.rule_pattern().replace(",", ",,").replace(",,|", ",|").replace(",,)", ",)")}'), lambda x: replace(x[2:], ',,', ',')) AS t
  FROM ids),
first AS (
  SELECT doc_id, licence, min(pos) AS pos FROM (SELECT doc_id, unnest(t) AS chain, generate_subscripts(t, 1) AS pos FROM taken) JOIN rules USING (chain)
  GROUP BY doc_id, licence),
named AS (SELECT doc_id, string_agg(licence, ',' ORDER BY pos) AS licences FROM first GROUP BY doc_id)
SELECT d.doc_id, coalesce(i.chain, '') AS sentences, coalesce(n.licences, '') AS licences
FROM documents d LEFT JOIN ids i USING (doc_id) LEFT JOIN named n USING (doc_id)
"""


@register(_licence_sql())
def op5_licence_sentences(spark: SparkSession, sf: str) -> DataFrame:
    found = licences.scan_licences(documents(spark, sf))
    return found.select("doc_id", F.array_join("sentences", ",").alias("sentences"), F.array_join("licences", ",").alias("licences"))


@register()
def op6_page_text(spark: SparkSession, sf: str) -> DataFrame:
    return pages.extract_text(spark.read.parquet(f"{sf}/pages.parquet"))


#: Damage, faults, and a table of the cheapest (cost, audit, repaired text) by row and state: states 1 to 4 are nothing yet,
#: after system, after user, after assistant.  Strings of equal cost in one state are never prefixes of each other.
DIALOGUE_SQL = r"""
WITH RECURSIVE
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
          coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hashed AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)),
    lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END))) % 20 AS harm
  FROM keyed),
hurt AS (
  SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE harm WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE harm <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM hurt),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM ordered),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault FROM placed),
steps AS (SELECT conv_id, pos, role, text, substr(role, 1, 1) AS r, coalesce(fault, '') = 'truncated' AS cut, coalesce(fault, '') IN ('blank', 'duplicate') AS gone FROM faulty),
best AS (
  SELECT conv_id, 0 AS pos, [{'c': 0, 'a': '', 't': ''}, {'c': 99999999, 'a': '', 't': ''}, {'c': 3, 'a': 'I', 't': 'user:' || chr(10)}, {'c': 6, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)}] AS s
  FROM (SELECT DISTINCT conv_id FROM hurt)
  UNION ALL
  SELECT conv_id, pos, [s1, s2, s3, list_sort([s4, {'c': s3.c + 3, 'a': s3.a || 'I', 't': s3.t || 'assistant:' || chr(10)}])[1]]
  FROM (
    SELECT conv_id, pos, s1, s2, s4, list_sort([s3,
      {'c': s1.c + 3, 'a': s1.a || 'I', 't': s1.t || 'user:' || chr(10)}, {'c': s2.c + 3, 'a': s2.a || 'I', 't': s2.t || 'user:' || chr(10)},
      {'c': s4.c + 3, 'a': s4.a || 'I', 't': s4.t || 'user:' || chr(10)}])[1] AS s3
    FROM (
      SELECT b.conv_id, x.pos,
        {'c': s[1].c + 4, 'a': s[1].a || 'D', 't': s[1].t} AS s1,
        list_sort([{'c': s[2].c + 4, 'a': s[2].a || 'D', 't': s[2].t},
          {'c': CASE WHEN gone OR r <> 's' THEN 99999999 ELSE s[1].c + p END, 'a': s[1].a || 'K', 't': s[1].t || line}])[1] AS s2,
        list_sort([{'c': s[3].c + 4, 'a': s[3].a || 'D', 't': s[3].t},
          {'c': CASE WHEN gone THEN 99999999 ELSE s[1].c + p + u END, 'a': s[1].a || lu, 't': s[1].t || tu},
          {'c': CASE WHEN gone THEN 99999999 ELSE s[2].c + p + u END, 'a': s[2].a || lu, 't': s[2].t || tu},
          {'c': CASE WHEN gone THEN 99999999 ELSE s[4].c + p + u END, 'a': s[4].a || lu, 't': s[4].t || tu}])[1] AS s3,
        list_sort([{'c': s[4].c + 4, 'a': s[4].a || 'D', 't': s[4].t},
          {'c': CASE WHEN gone THEN 99999999 ELSE s[3].c + p + CASE r WHEN 'a' THEN 0 ELSE 3 END END,
           'a': s[3].a || CASE r WHEN 'a' THEN 'K' ELSE 'R' END, 't': s[3].t || CASE r WHEN 'a' THEN line ELSE 'assistant:' || text || chr(10) END}])[1] AS s4
      FROM best b JOIN (
        SELECT *, CASE WHEN cut THEN 3 ELSE 0 END AS p, role || ':' || text || chr(10) AS line, CASE r WHEN 'u' THEN 0 ELSE 3 END AS u,
               CASE r WHEN 'u' THEN 'K' ELSE 'R' END AS lu, CASE r WHEN 'u' THEN role || ':' || text || chr(10) ELSE 'user:' || text || chr(10) END AS tu
        FROM steps) x ON x.conv_id IS NOT DISTINCT FROM b.conv_id AND x.pos = b.pos + 1))),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM faulty GROUP BY conv_id),
ends AS (SELECT c.*, list_sort([b.s[1], b.s[4]])[1] AS e FROM counts c JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND b.pos = c.n)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(e.c, 0) AS BIGINT) AS cost, coalesce(e.a, '') AS audit,
       sha256(coalesce(left(e.t, greatest(length(e.t) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ends x ON o.conv_id IS NOT DISTINCT FROM x.conv_id
"""


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with a twentieth each of turns dropped, emptied, without end marks, repeated and of a wrong role."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.pmod(F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")), F.lit(20))
    text = F.when(harm == 1, F.lit("")).when(harm == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    copies = F.when(harm == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    kept = turns.where(harm != 0)
    return kept.select("conv_id", "turn", F.when(harm == 4, F.lit("user")).otherwise(blank("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


@register(DIALOGUE_SQL)
def op11_dialogue_repair(spark: SparkSession, sf: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    reports = dialogues.conversation_reports(damaged(turns))
    ids = turns.select("conv_id").distinct()
    found = ids.alias("i").join(reports.alias("r"), F.col("i.conv_id").eqNullSafe(F.col("r.conv_id")), "left")
    numbers = [F.coalesce(f"r.{c}", F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    digest = F.coalesce("r.repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return found.select("i.conv_id", *numbers, F.coalesce("r.audit", F.lit("")).alias("audit"), digest)


def _secrets_sql() -> str:
    """Offsets from the lengths of the pieces between matches; each window's entropy from its own counts."""
    quoted = lambda x: x.replace("'", "''")
    patterns = (secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.CANDIDATE)
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS place, '{kind}' AS kind, regexp_extract_all(t, '{quoted(p)}') AS m, string_split_regex(t, '{quoted(p)}') AS b FROM d"
        for i, (kind, p) in enumerate(zip(secrets.KINDS, patterns))
    )
    classes = " ".join(f"WHEN regexp_matches(m, '{p}') THEN {bits}" for _, p, bits in secrets.CLASSES[:-1])
    allowed = "|".join(f"(?:{quoted(p)})" for p in secrets.ALLOWED)
    w = secrets.WIDTH
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
placed AS (
  SELECT doc_id, place, kind, unnest(m) AS m, generate_subscripts(m, 1) AS i, m AS ms, b FROM found),
spans AS (
  SELECT doc_id, place, kind, m,
         CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM placed),
windows AS (
  SELECT doc_id, s, m, i, unnest(string_split(substr(m, i, {w}), '')) AS ch
  FROM (SELECT doc_id, s, m, unnest(range(1, length(m) - {w} + 2)) AS i FROM spans
        WHERE place = 3 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]'))),
counts AS (SELECT doc_id, s, m, i, ch, count(*) AS n FROM windows GROUP BY ALL),
bits AS (SELECT doc_id, s, m, i, -sum(n / {w} * log2(n / {w})) AS h FROM counts GROUP BY ALL),
random AS (
  SELECT doc_id, s FROM bits
  WHERE NOT regexp_matches(m, '^[0-9a-f]{{{secrets.MIN_HEX},}}$|^AKIA[A-Z0-9]{{{secrets.MIN_ACCESS - 4},}}$') AND NOT regexp_matches(m, '{allowed}')
  GROUP BY doc_id, s, m HAVING max(h) >= CASE {classes} ELSE {secrets.CLASSES[-1][2]} END),
kept AS (
  SELECT *, kind || ':' || s || ':' || (s + length(m)) AS span FROM spans p
  WHERE (place = 0 AND length(regexp_extract(m, '{quoted(secrets.ASSIGN)}', 1)) >= {secrets.MIN_VALUE})
     OR (place = 1 AND length(m) >= {secrets.MIN_ACCESS}) OR (place = 2 AND length(m) >= {secrets.MIN_HEX})
     OR (place = 3 AND EXISTS (SELECT 1 FROM random r WHERE r.doc_id = p.doc_id AND r.s = p.s)))
SELECT d.doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY s, place) FILTER (place < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY s, place), '') AS spans
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id GROUP BY d.doc_id
"""


@register(_secrets_sql())
def op12_secret_entropy(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.scan_secrets(documents(spark, sf))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans")
    )


@register()
def op13_qdwh_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.by_component(whitening.whiten_vectors(spark.read.parquet(f"{sf}/embeddings.parquet")))


@register()
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
