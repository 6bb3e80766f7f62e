"""The queries of the numbered operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .decontam import CONSISTENCY, COVERAGE, FEWEST, PASSAGE, PLAIN, SHORTEST, UNITS, WINDOW


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_round_trip

    out = media_round_trip(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "type_corrected", F.size("carved").alias("n_carved"), "n_payload_media")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_round_trip

    return warc_round_trip(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")).drop("row")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links", "n_linked_texts", "n_grams")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_texts

    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    out = score_texts(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress, with_group_error

    coded, books = compress(table(spark, sf_dir, "embeddings"))
    out = with_group_error(staged(coded.drop("embedding"), "codes"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL | {"op11_vector_codes": _codes_sql(), "op13_hard_negatives": _negatives_sql()}


_WHOLE = "embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)"


def _codes_sql(rounds: int = 6) -> str:
    """The rounds one behind the other."""
    steps = ["c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 16)"]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min(list_sum([(x[i] - c[i]) * (x[i] - c[i]) for i in range(1, len(x) + 1)])::HUGEINT * 16 + e) AS m FROM parts JOIN c{i} USING (p) GROUP BY r, p)")
        if i < rounds:
            steps.append(f"u{i} AS (SELECT p, (m % 16)::BIGINT AS e, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM a{i})")
            steps.append(f"s{i} AS (SELECT p, e, i, sum(v)::HUGEINT AS s, count(*) AS n FROM u{i} GROUP BY ALL)")
            steps.append(f"n{i} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{i} GROUP BY p, e)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(n{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN n{i} USING (p, e))")
    return f"""
        WITH good AS (SELECT * FROM embeddings WHERE {_WHOLE}),
        size AS (SELECT len(embedding) AS d FROM good WHERE len(embedding) > 0 AND len(embedding) % 8 = 0 GROUP BY 1 ORDER BY count(*) DESC, d DESC LIMIT 1),
        kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM good, size WHERE len(embedding) = d),
        parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // 8 + 1:(p + 1) * len(v) // 8] AS x FROM kept, range(8) t(p)),
        {", ".join(steps)},
        coded AS (SELECT r, string_agg(printf('%02x', (m % 16)::BIGINT), '' ORDER BY p) AS code, sum(m // 16)::BIGINT AS error FROM a{rounds} GROUP BY r)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
        FROM kept JOIN coded USING (r)"""


def _negatives_sql() -> str:
    return f"""
        WITH good AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings WHERE label IS NOT NULL AND {_WHOLE}),
        size AS (SELECT len(embedding) AS d FROM good WHERE len(embedding) > 0 GROUP BY 1 ORDER BY count(*) DESC, d DESC LIMIT 1),
        kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM good, size WHERE len(embedding) = d),
        scored AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, b.r AS o, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.vec_id IS DISTINCT FROM b.vec_id),
        positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, other NULLS LAST) <= 5),
        hard AS (SELECT p.anchor_id, p.other AS positive_id, row_number() OVER (PARTITION BY p.r, p.o ORDER BY n.score DESC, n.other NULLS LAST)::INT AS rank, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
            FROM positives p JOIN scored n ON p.r = n.r AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
        SELECT * FROM hard WHERE rank <= 10"""


ORACLE_SQL: dict[str, str] = {
    "op6_line_dedup": r"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        pieces AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM docs),
        keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM pieces),
        common AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        marked AS (SELECT k.*, c.key IS NOT NULL AND (k.doc_id IS NULL OR k.doc_id < c.top) AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY r, doc_id""",
    "op8_source_mix": r"""
        WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, length(coalesce(text, ''))::DOUBLE AS chars,
            substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 12) AS digest FROM documents),
        keyed AS (SELECT doc_id, source, size, -ln((('0x' || digest)::BIGINT::DOUBLE + 0.5) / 281474976710656.0) / greatest(0.2, 1.0 - abs(chars / greatest(size, 1) - 6.0) / 10.0) AS k FROM docs),
        sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY 1),
        weighed AS (SELECT *, source_size * 2.0::DOUBLE AS cap, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM sources),
        levels AS (SELECT *, cap / w AS turn, ((sum(source_size) OVER () * 1.5::DOUBLE) - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
            FROM weighed WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        water AS (SELECT arg_min(level, turn) FILTER (level <= turn) AS level FROM levels),
        targets AS (SELECT l.source, source_size, CASE WHEN water.level IS NULL THEN cap ELSE least(cap, water.level * w) END AS target FROM levels l, water),
        ordered AS (SELECT k.doc_id, k.source, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs,
            sum(size) OVER (PARTITION BY k.source ORDER BY k, k.doc_id NULLS LAST ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - (upto - size))))::BIGINT AS taken, source, epochs FROM ordered""",
    "op2_warc": r"""
        WITH raw AS (SELECT page_id, coalesce(html, '') AS body, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS turn,
            min(page_id) OVER (PARTITION BY coalesce(html, '')) AS lead FROM pages),
        bits AS (SELECT *, list_aggregate(list_transform(string_split(sha1(body), ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), 'string_agg', '') AS b FROM raw)
        SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
            list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_sum(list_transform(range(5), lambda j: substr(b, (5 * i + j + 1)::INT, 1)::INT * (16 >> j::INT)))::INT + 1, 1)), 'string_agg', '') AS payload_digest,
            CASE WHEN turn = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN turn > 1 THEN lead END AS refers_to,
            CASE WHEN turn = 1 THEN true END AS digest_ok FROM bits""",
    "op5_ngram_join": r"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-/:-@\[-`{-\x7f]+'), lambda x: x <> '') AS w FROM documents),
        g AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
        n AS (SELECT d.r, doc_id, count(s) AS n, md5(coalesce(string_agg(s, '|' ORDER BY s), '')) AS k FROM d LEFT JOIN g ON d.r = g.r GROUP BY 1, 2),
        shared AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.r <> b.r GROUP BY 1, 2
                 UNION ALL SELECT a.r, b.r, 0 FROM n a JOIN n b ON a.n = 0 AND b.n = 0 AND a.r <> b.r),
        links AS (SELECT x, y, b.k AS other, a.k AS own FROM shared JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9),
        reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
        classes AS (SELECT x, min(doc_id) AS class_id FROM reach JOIN d ON d.r = y GROUP BY 1),
        counts AS (SELECT x, count(*) AS n_links, count(DISTINCT other) FILTER (other <> own) AS n_linked_texts FROM links GROUP BY 1)
        SELECT n.doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_linked_texts, 0)::BIGINT AS n_linked_texts, n::INT AS n_grams FROM n JOIN classes c ON c.x = n.r LEFT JOIN counts k ON k.x = n.r""",
    "op3_decontamination": rf"""
        WITH texts AS (SELECT 0 AS side, doc_id AS id, text FROM (SELECT DISTINCT doc_id, text FROM documents) UNION ALL SELECT 1, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark) WHERE item_id IS NOT NULL),
        numbered AS (SELECT side, id, row_number() OVER () AS r, coalesce(text, '') AS t FROM texts),
        marked AS (SELECT side, id, r, 0 AS form, regexp_replace(t, '([\p{{L}}\p{{N}},;] )(\p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)*)', '\1' || chr(2) || '\2' || chr(3), 'g') AS t FROM numbered
            UNION ALL SELECT side, id, r, 1, regexp_replace(t, '(^|[^\p{{L}}])(\p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)*)', '\1' || chr(2) || '\2' || chr(3), 'g') FROM numbered
            UNION ALL SELECT side, id, r, form, t FROM numbered, (VALUES (2), (3)) f(form)),
        cut AS (SELECT side, id, r, form, regexp_extract_all(lower(t), chr(2) || '[^' || chr(3) || ']*' || chr(3) || '|[0-9]+(?:[.,][0-9]+)*|\p{{L}}+') AS toks FROM marked),
        canon AS (SELECT *, len(toks) AS n, list_transform(toks, lambda x, i: CASE WHEN form = 3 THEN 'a' || x WHEN x >= 'A' THEN CASE WHEN i > 1 AND toks[i - 1] >= '0' AND toks[i - 1] < ':' AND list_contains({list(UNITS)}, x) THEN chr(3) ELSE x END
            WHEN x >= '0' AND x < ':' THEN chr(1) ELSE chr(2) END) AS c FROM cut),
        items AS (SELECT *, least(n, {WINDOW}) AS k FROM canon WHERE side = 1 AND n >= CASE WHEN form = 3 THEN {FEWEST} ELSE {SHORTEST} END),
        iw AS (SELECT r AS ir, form, k, n, unnest(range(1, n - k + 2)) AS ipos, unnest(list_transform(range(1, n - k + 2), lambda p: list_slice(c, p, p + k - 1))) AS w FROM items),
        usual AS (SELECT * FROM iw WHERE form < 3 AND len(list_filter(w, lambda x: x >= 'A')) >= {PLAIN}),
        good AS (FROM usual UNION ALL FROM iw WHERE form = 3 AND ir NOT IN (SELECT ir FROM usual)),
        sizes AS (SELECT ir, form, count(*) AS n_windows, CASE WHEN form = 3 THEN count(*) ELSE least({COVERAGE} * count(*), {PASSAGE - WINDOW + 1}) END AS need FROM good GROUP BY ir, form),
        dw AS (SELECT r, form, ks.k AS k, unnest(range(1, n - ks.k + 2)) AS dpos, unnest(list_transform(range(1, n - ks.k + 2), lambda p: list_slice(c, p, p + ks.k - 1))) AS w
            FROM canon JOIN (SELECT DISTINCT form, k FROM good) ks USING (form) WHERE side = 0 AND n >= ks.k),
        hits AS (SELECT DISTINCT dw.r AS r, ir, dw.form AS form, ipos, good.k AS k, dpos - ipos AS shift FROM dw JOIN good ON dw.w = good.w AND dw.k = good.k AND dw.form = good.form),
        held AS (SELECT r, ir, form, n_windows, need FROM hits JOIN sizes USING (ir, form) GROUP BY ALL HAVING count(DISTINCT ipos) >= need),
        places AS (SELECT * FROM hits JOIN held USING (r, ir, form)),
        laid AS (SELECT r, ir, form, n_windows, need, 1 AS kind, shift AS base, ipos, k, shift FROM places
            UNION ALL SELECT r, ir, form, n_windows, need, 2, base, ipos, k, arg_min(shift, 2 * abs(shift - base) + (shift > base)::INT) FROM places JOIN (SELECT DISTINCT r, ir, form, shift AS base FROM places) USING (r, ir, form)
                WHERE form < 3 AND abs(shift - base) <= n_windows GROUP BY ALL),
        enough AS (SELECT r, ir, form, n_windows, kind, base, count(*) AS n_matched FROM laid GROUP BY r, ir, form, n_windows, need, kind, base HAVING count(*) >= need),
        pairs AS (SELECT DISTINCT l.r, l.ir, l.form, l.kind, l.base, i.toks[l.ipos + j] AS a, d.toks[l.ipos + l.shift + j] AS b FROM laid l SEMI JOIN enough USING (r, ir, form, kind, base)
            JOIN canon i ON i.r = l.ir AND i.form = l.form JOIN canon d ON d.r = l.r AND d.form = l.form, range({WINDOW}) x(j) WHERE j < l.k AND i.c[l.ipos + j] < 'A'),
        slots AS (SELECT r, ir, form, kind, base, count(DISTINCT a) AS n_slots, count(DISTINCT a) / greatest(count(*), count(DISTINCT b)) AS share, bool_and(a = b) AS verbatim FROM pairs GROUP BY ALL),
        judged AS (SELECT r, ir, form, n_windows, n_matched, coalesce(n_slots, 0)::INT AS n_slots, coalesce(share, 1.0)::DOUBLE AS slot_consistency, coalesce(verbatim, true) AS verbatim FROM enough LEFT JOIN slots USING (r, ir, form, kind, base)),
        best AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY r, ir, form ORDER BY slot_consistency DESC, verbatim DESC, n_matched DESC, n_slots DESC) = 1),
        told AS (SELECT best.*, d.id AS doc_id, i.id AS item_id FROM best JOIN numbered d ON d.r = best.r JOIN numbered i ON i.r = best.ir WHERE slot_consistency >= {CONSISTENCY}
            QUALIFY row_number() OVER (PARTITION BY best.r, i.id ORDER BY verbatim DESC, form, slot_consistency DESC, n_matched / n_windows DESC, n_matched DESC, n_windows DESC, n_slots DESC) = 1)
        SELECT doc_id, item_id, n_windows, n_matched, n_matched / n_windows AS coverage, n_slots, slot_consistency, verbatim FROM told""",
}
