"""The registered queries of the operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hardneg, licenses, linededup, mixing, neardup, quality, resampling, secrets, simhash, topk, toxicity, urlfilter
from .common import read_table

VOCABULARY = "byte_bpe_50k.json"
#: Rows whose vec_id this number divides take the next label before negatives are mined.
RELABELLED = 7


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return licenses.scan_licenses(docs.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "cleaned.n_lines", "cleaned.n_dropped", F.sha2("cleaned.text", 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.fingerprint_text().alias("fingerprint"), "component_id")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read_table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    coded = bpe.encode_decode(docs.select("doc_id", "text"), vocabulary_path())
    ids = F.array_join(F.col("coded.ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("coded.ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("coded.decoded", 256).alias("decoded_sha256"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(read_table(spark, sf_dir, "embeddings"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("found.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secrets.KINDS), F.sha2(secrets.spans_text("found.base"), 256).alias("base_sha256"), secrets.spans_text("found.spans").alias("spans"), F.col("found.n_oversized").cast("long").alias("n_oversized"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 9))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = resampling.importance_ranks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return ranks.select("doc_id", "n_features", "weight", "score", "rank")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % RELABELLED == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(vectors.withColumn("label", moved))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    return urlfilter.filter_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "filter.*")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_line_dedup, op3_toxicity, op4_simhash, op5_bpe, op6_topk, op7_secrets, op8_embedding_dedup, op9_mixing, op10_quality, op11_resampling, op12_hard_negatives, op13_url_filter)}


def _license_sql() -> str:
    body = licenses.bodies()
    templates = ", ".join(f"({i}, '{name}', '{word}', {n}, {key}, {str(body[i]).lower()})" for i, name, word, n, key in licenses.template_words())
    words = lambda x: f"regexp_extract_all(translate({x}, '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.WORDS}')"
    return f"""
    with recursive templates(template, license, word, n, key, body) as (values {templates}),
    files as (select doc_id, doc_id as file, concat_ws('/', source, lang, doc_id::varchar) as path, text from documents),
    spoken as (select file, text from files where regexp_matches(text, '{licenses.TRIGGER}')),
    split as (select file, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from spoken),
    around as (select *, lag(line) over w as before, lead(line) over w as after, lead(line, 2) over w as later from split window w as (partition by file order by pos)),
    lines as (select * from around where regexp_matches(line, '{licenses.TRIGGER}')),
    parts as (select file, pos * 3 as part, line as text from lines union all select file, pos * 3 + 1, concat_ws(' ', before, line, after) from lines union all select file, pos * 3 + 2, concat_ws(' ', line, after, later) from lines union all select file, {licenses.WHOLE}, text from spoken),
    bags as (select file, part, word, count(*) as n from (select file, part, unnest({words("text")}) as word from parts) group by all),
    total as (select count(*) as total from lines),
    line_words as (select distinct file, part, word from bags where part >= 0 and part % 3 = 0),
    idf as (select word, ln((any_value(total) + 1) / (count(part) + 1)) + 1 as idf from (select distinct word from templates) cross join total left join line_words using (word) group by word),
    norms as (select file, part, sqrt(sum((n * coalesce(i.idf, (select ln(total + 1) + 1 from total))) ** 2)) as norm from bags left join idf i using (word) group by file, part),
    template_norms as (select template, any_value(license) as license, sqrt(sum((n * idf) ** 2)) as norm, sum(key) filter (key > 0) as keys, any_value(body) as body from templates join idf using (word) group by template),
    dots as (select file, part, template, sum(b.n * t.n * idf * idf) as dot, sum(key) as keys from bags b join idf using (word) join templates t using (word) group by file, part, template),
    rated as (select d.file, d.part, t.license, round(dot / (n.norm * t.norm), 6) as cosine from dots d join norms n using (file, part) join template_norms t using (template) where d.keys = t.keys and (d.part >= 0 or t.body)),
    own as (select file, cosine, license from rated where part >= 0 qualify row_number() over (partition by file order by cosine desc, license) = 1),
    whole as (select file, cosine, license from rated where part = {licenses.WHOLE} qualify row_number() over (partition by file order by cosine desc, license) = 1),
    picked as (select f.doc_id, f.path, o.cosine as own_cosine, o.license as own_license, w.cosine as whole_cosine, w.license as whole_license, coalesce(o.cosine >= {licenses.HEADER_COSINE}, false) as header, coalesce(w.cosine >= {licenses.FILE_COSINE}, false) as body,
        regexp_matches(regexp_extract(f.path, '[^/]*$'), '{licenses.LICENSE_FILE}') as named from files f left join own o using (file) left join whole w using (file)),
    marked as (select doc_id, path, regexp_replace(path, '/?[^/]*$', '') as dir, case when header then own_license when body then whole_license end as mine, case when header then own_cosine when body then whole_cosine end as cosine, (header or body) and (body or named) as ruling from picked),
    tops as (select dir, mine from marked where ruling qualify row_number() over (partition by dir order by cosine desc, mine) = 1),
    chains(dir, up, place) as (select dir, 0, dir from (select distinct dir from marked) union all select dir, up + 1, regexp_replace(place, '/?[^/]*$', '') from chains where place <> ''),
    resolved as (select c.dir, t.mine as license, c.place from chains c join tops t on t.dir = c.place qualify row_number() over (partition by c.dir order by up) = 1)
    select doc_id, path, coalesce(mine, r.license) as license, case when ruling then 'file' when mine is not null then 'header' when r.license is not null then 'inherited' else 'none' end as origin,
        cosine, case when mine is null then r.place end as license_dir
    from marked left join resolved r using (dir)"""


def _resampling_sql() -> str:
    """CRC-32 of distinct words, by its table, which follows from the polynomial."""
    half = "[case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end for c in {}]"
    table = "[x for x in range(256)]"
    for _ in range(8):
        table = half.format(table)
    nibbles = "[('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::bigint for i in range(1, octet_length(encode(word)) + 1)]"
    crc = f"xor(list_reduce({nibbles}, lambda c, b: xor(c >> 8, t.crcs[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
    words = f"[w for w in string_split_regex(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{resampling.SEPARATORS}') if w <> '']"
    b = resampling.BUCKETS
    return f"""
    with docs as (select row_number() over () as r, doc_id, {words} as words from documents),
    source as (select r, unnest(words) as word from docs),
    target as (select unnest({words}) as word from benchmark),
    crc_table as (select {table} as crcs),
    hashes as (select word, {crc} % {b} as bucket from (select distinct word from (select word from source union all select word from target)), crc_table t),
    s as (select bucket, count(*) as n from source join hashes using (word) group by bucket),
    t as (select bucket, count(*) as n from target join hashes using (word) group by bucket),
    gains as (select k.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select count(*) from source) + {b})::double / ((coalesce(s.n, 0) + 1)::double * ((select count(*) from target) + {b})::double)))::bigint as gain
        from range({b}) k(bucket) left join s using (bucket) left join t using (bucket)),
    weights as (select r, sum(gain)::bigint as weight from source join hashes using (word) join gains using (bucket) group by r),
    scored as (select doc_id, len(words)::bigint as n_features, coalesce(weight, 0) as weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score from docs left join weights using (r)),
    placed as (select *, row_number() over (order by score desc, doc_id nulls last, weight, n_features) as place, count(*) over () as n from scored where n_features >= {resampling.MIN_WORDS})
    select doc_id, n_features, weight, score, case when place <= n * {resampling.PERCENT} // 100 then place end as rank from placed
    union all select doc_id, n_features, weight, score, null from scored where n_features < {resampling.MIN_WORDS}"""


def _negatives_sql() -> str:
    ints = "[floor(256 * x::double)::bigint for x in embedding]"
    return f"""
    with v as (select vec_id, case when vec_id % {RELABELLED} = 0 then (label + 1) % 10 else label end as label, {ints} as x from embeddings
        where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
    s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_dot_product(a.x::double[], c.x::double[])::bigint as score from v a join v c on a.vec_id <> c.vec_id where a.vec_id % {hardneg.EVERY} = 0),
    p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {hardneg.POSITIVES}),
    n as (select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id) as rank
        from p join s using (anchor_id) where not s.same and {hardneg.LOW} * positive_score <= 100 * s.score and 100 * s.score <= {hardneg.HIGH} * positive_score)
    select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= {hardneg.NEGATIVES}"""


def _urls_sql() -> str:
    rules = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in urlfilter.RULES)
    part = lambda i: f"regexp_extract(coalesce(url, ''), '{urlfilter.PARTS}', {i})"
    return f"""
    with rules(h, p, v) as (values {rules}),
    u as (select row_number() over () as r, page_id, translate({part(1)}, '{licenses.UPPER}', '{licenses.LOWER}') as host, {part(2)} as path from pages),
    fit as (select r, h || p as rule, v from u join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) qualify row_number() over (partition by r order by length(h || p) desc, length(h) desc) = 1)
    select page_id, host, path, rule, coalesce(v, '{urlfilter.DEFAULT}') as verdict from u left join fit using (r)"""


def oracle_sql() -> dict[str, str]:
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    key = f"translate(trim(line, {white}), '{licenses.UPPER}', '{licenses.LOWER}')"
    ints = "[floor(256 * x::double)::bigint for x in embedding]"
    u = "('0x' || substr(md5('mix-1|' || coalesce(doc_id::varchar, '') || '|' || i), 1, 13))::bigint / 4503599627370496.0"
    return {
        "op1_license_scan": _license_sql(),
        "op11_resampling": _resampling_sql(),
        "op12_hard_negatives": _negatives_sql(),
        "op13_url_filter": _urls_sql(),
        "op2_line_dedup": f"""
            with l as (select r, doc_id, pos, line, {key} as key from (select r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from (select row_number() over () as r, doc_id, text from documents))),
            often as (select key from l where key <> '' group by key having count(distinct r) >= {linededup.MIN_DOCS})
            select doc_id, count(*) as n_lines, count(o.key) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where o.key is null), '')) as kept_sha256
            from l left join often o using (key) group by r, doc_id""",
        "op6_topk": f"""
            with v as (select vec_id, {ints} as x from embeddings where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
            s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.x::double[], c.x::double[])::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % {topk.EVERY} = 0)
            select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= {topk.K}""",
        "op8_embedding_dedup": f"""
            with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where embedding is not null and label is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
            n as (select *, sqrt(list_dot_product(e, e)) as size from v where list_dot_product(e, e) > 0),
            link as (select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id where list_dot_product(a.e, b.e) / (a.size * b.size) >= {neardup.THRESHOLD}),
            reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on l.a = r.b)
            select vec_id, coalesce(l.n, 0) as n_links, least(vec_id, coalesce(r.least, vec_id)) as component_id, vec_id <= coalesce(r.least, vec_id) as kept
            from embeddings left join (select a, count(*) as n from link group by a) l on l.a = vec_id left join (select a, min(b) as least from reach group by a) r on r.a = vec_id""",
        "op9_mixing": f"""
            with recursive counts as (select coalesce(source, '') as s, count(*)::double as n from documents group by 1),
            rates as (select s, (select sum(n) from counts) * pow(n, {mixing.POWER}) / (select sum(pow(n, {mixing.POWER})) from counts) / n as rate from counts),
            parts as (select s, rate, greatest(ceil(rate / {mixing.MAX_RATE}), 1)::int as parts from rates),
            steps(s, k, p, cum) as (select s, 0, exp(-rate / parts), exp(-rate / parts) from parts union all select s, k + 1, p * (rate / parts) / (k + 1), cum + p * (rate / parts) / (k + 1) from steps join parts using (s) where k < ceil(rate / parts + 12 * sqrt(rate / parts) + 20)),
            draws as (select d.doc_id, d.text, d.lang, d.source, d.n_chars, p.s, p.rate, i, {u} as u from documents d join parts p on p.s = coalesce(d.source, ''), range(1, parts + 1) r(i)),
            times as (select doc_id, text, lang, source, n_chars, any_value(rate) as rate, sum((select count(*) from steps t where t.s = draws.s and t.cum <= draws.u)) as n from draws group by all)
            select doc_id, text, lang, source, n_chars, round(rate, 9) as rate, c::int as copy, md5('mix-1|order|' || coalesce(doc_id::varchar, '') || '|' || c) as shuffle_key from times, range(0, n::bigint) r(c)""",
    }
