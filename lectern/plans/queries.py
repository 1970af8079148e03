"""The registered queries of the library, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import display, encoding, files, quality, reading, text
from lectern.functions.columns import computed
from lectern.operators import chapters, containers, decoding, library, progress
from lectern.plans import edge_queries, file_queries, sql  # noqa: F401  (these register their own)
from lectern.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from lectern.plans.tables import named, progress_events, table
from lectern.plans.tables import library as lib
from lectern.sources import settings, store

def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# Words and chunks.


@query(f"SELECT doc_id, len({sql.words('text')}) :: BIGINT AS word_count FROM documents")
def word_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.word_count(F.col("text")).cast("long").alias("word_count"))


def chunk_rows(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, chunk_index, words, orp_index): one row for each chunk, exploded last."""
    rows = docs.select("doc_id", F.posexplode(reading.chunks(reading.reading_words(F.col("text")), size)).alias("chunk_index", "words"))
    return rows.withColumn("orp_index", reading.recognition_point(F.col("words")))


def _chunk_sql(size: int, docs: str = "documents") -> str:
    return f"""WITH w AS (SELECT doc_id, {sql.reading_words('text')} AS ws FROM {docs}), i AS (SELECT doc_id, ws, unnest(range(0, len(ws), {size})) AS i FROM w),
c AS (SELECT doc_id, (i // {size}) :: INTEGER AS chunk_index, list_slice(ws, i + 1, i + {size}) AS words FROM i)"""


def _chunk_oracle(size: int) -> str:
    return _chunk_sql(size) + f" SELECT doc_id, chunk_index, array_to_string(words, ' ') AS chunk, {sql.point('words', 'len(words)')} AS orp_index FROM c"


@query(_chunk_oracle(1))
def rsvp_chunks_1(spark, sf_dir):
    return chunk_rows(_docs(spark, sf_dir), 1).select("doc_id", "chunk_index", F.array_join("words", " ").alias("chunk"), "orp_index")


@query(_chunk_oracle(3))
def rsvp_chunks_3(spark, sf_dir):
    return chunk_rows(_docs(spark, sf_dir), 3).select("doc_id", "chunk_index", F.array_join("words", " ").alias("chunk"), "orp_index")


@query(_chunk_sql(2) + f", p AS (SELECT {sql.point('words', 'len(words)')} AS orp_index FROM c) SELECT orp_index, count(*) AS n FROM p GROUP BY orp_index")
def orp_distribution(spark, sf_dir):
    return chunk_rows(_docs(spark, sf_dir), 2).groupBy("orp_index").agg(F.count("*").alias("n"))


@query(f"WITH w AS (SELECT doc_id, len({sql.reading_words('text')}) :: BIGINT AS words FROM documents) SELECT doc_id, words, ceil(words / 3.0) :: BIGINT AS chunks, 60000.0 :: DOUBLE / 300 * words AS full_ms, 60000.0 :: DOUBLE / 300 * 3 * ceil(words / 3.0) :: BIGINT AS slot_ms FROM w")
def chunk_durations(spark, sf_dir):
    """Reading time of the words, and of the slots that playback gives: a short last chunk has a whole slot."""
    rows = _docs(spark, sf_dir).select("doc_id", F.size(reading.reading_words(F.col("text"))).cast("long").alias("words")).withColumn("chunks", F.ceil(F.col("words") / 3))
    return rows.withColumns({"full_ms": reading.duration_ms(F.col("words"), F.lit(300)), "slot_ms": reading.duration_ms(F.col("chunks"), F.lit(300)) * 3})


@query(_chunk_sql(5) + " SELECT doc_id, chunk_index, list_filter(words, lambda w: length(w) = list_max(list_transform(words, lambda v: length(v))))[1] AS longest FROM c")
def longest_word_per_chunk(spark, sf_dir):
    return chunk_rows(_docs(spark, sf_dir), 5).select("doc_id", "chunk_index", reading.longest_word(F.col("words")).alias("longest"))


def _fit_sql() -> str:
    step = f"WITH s0 AS (SELECT doc_id, coalesce(list_max(list_transform({sql.reading_words('text')}, lambda v: length(v))), 0) AS n, 32 * 0.35 :: DOUBLE AS lo, 32.0 :: DOUBLE AS hi FROM documents)"
    for k in range(1, 11):
        fits = "n * ((lo + hi) / 2 * 0.55 :: DOUBLE + 0.5 :: DOUBLE) <= 140.0 :: DOUBLE"
        step += f", s{k} AS (SELECT doc_id, n, CASE WHEN {fits} THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN {fits} THEN hi ELSE (lo + hi) / 2 END AS hi FROM s{k - 1})"
    return step + " SELECT doc_id, n :: INTEGER AS longest, round(greatest(32 * 0.35 :: DOUBLE, least(32.0 :: DOUBLE, CASE WHEN n > 0 THEN lo ELSE 32.0 :: DOUBLE END)), 9) AS font FROM s10"


@query(_fit_sql())
def fit_font(spark, sf_dir):
    """The font in which a document's longest word fits half a screen."""
    rows = _docs(spark, sf_dir).select("doc_id", reading.longest_word(reading.reading_words(F.col("text"))).alias("word"))
    return rows.select("doc_id", F.length("word").alias("longest"), F.round(reading.fitting_font(F.col("word"), F.lit(32), F.lit(140.0), F.lit(0.5)), 9).alias("font"))


@query(_chunk_sql(3) + f""", p AS (SELECT *, {sql.point('words', 'len(words)')} AS o, coalesce(words[len(words) // 2 + 1], '') AS w FROM c)
SELECT doc_id, chunk_index, CASE WHEN o < length(w) THEN left(w, o) ELSE '' END AS pre, CASE WHEN o < length(w) THEN substr(w, o + 1, 1) ELSE '' END AS focus, CASE WHEN o < length(w) THEN substr(w, o + 2) ELSE '' END AS post,
left(words[1], length(words[1]) // 3) AS left_context, substr(words[len(words)], floor(length(words[len(words)]) * 0.6 :: DOUBLE) :: BIGINT + 1) AS right_context FROM p""")
def orp_layout(spark, sf_dir):
    rows = chunk_rows(_docs(spark, sf_dir), 3)
    parts = reading.orp_parts(F.col("words"), F.col("orp_index"))
    return rows.select("doc_id", "chunk_index", *[parts[k].alias(k) for k in ("pre", "focus", "post", "left_context", "right_context")])


# Text normalisation.


def _text_query(name: str, source: str, key: str, column: str, rule, oracle: str) -> None:
    def run(spark, sf_dir):
        return table(spark, sf_dir, source).select(key, rule(F.col(column)).alias("result"))

    run.__name__ = name
    query(f"SELECT {key}, {oracle} AS result FROM {source}")(run)


_text_query("clean_text", "documents", "doc_id", "text", text.clean_text, sql.clean("text"))
_text_query("markup_to_plain", "pages", "page_id", "html", text.markup_to_plain, sql.markup_to_plain("html"))
_text_query("strip_html", "pages", "page_id", "html", text.strip_html, sql.strip_html("html"))
_text_query("normalize_unicode", "documents", "doc_id", "text", text.normalize_unicode, sql.normalize_unicode("text"))
_text_query("sanitize_control", "documents", "doc_id", "text", text.sanitize_control, sql.sanitize("text"))
_text_query("recognized_text", "documents", "doc_id", "text", text.recognized_text, sql.sub(sql.sub(sql.unix_lines(sql.trim("text")), r"\n{3,}", "\n\n"), r"[ \t]+", " "))
_text_query("uri_names", "pages", "page_id", "url", files.name_in_uri, "coalesce(list_filter(string_split(split_part(split_part(url, '?', 1), '#', 1), '/'), lambda p: p <> '')[-1], 'document')")


@query(f"SELECT doc_id, {', '.join(f'round({e}, 9) AS {k}' if k != 'mojibake_count' else f'({e}) :: INTEGER AS {k}' for k, e in sql.quality('text').items())} FROM documents")
def text_quality(spark, sf_dir):
    found = quality.quality_columns(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", *[F.round(found[k], 9).alias(k) for k in ("readability", "ascii_letter_ratio", "space_ratio", "english_density")], found["mojibake_count"].cast("int").alias("mojibake_count"))


_SCORE = "WITH q AS (SELECT doc_id, length(left(text, 24000)) AS n, " + ", ".join(f"{e} AS {k}" for k, e in sql.quality("text").items()) + " FROM documents)"


@query(_SCORE + " SELECT doc_id, round(readability * 0.45 :: DOUBLE + ascii_letter_ratio * 0.2 :: DOUBLE + space_ratio * 0.05 :: DOUBLE + english_density * 0.3 :: DOUBLE - least(0.6 :: DOUBLE, mojibake_count :: DOUBLE / greatest(1, n) * 40), 9) AS score FROM q")
def text_scores(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(quality.quality_columns(F.col("text"))["score"], 9).alias("score"))


@query(f"SELECT doc_id, {', '.join(f'round({e}, 9) AS {k}' if k != 'mojibake_count' else f'({e}) :: INTEGER AS {k}' for k, e in sql.quality('text', True).items())} FROM documents")
def whole_text_quality(spark, sf_dir):
    """The same measures of every character and word, however long the text."""
    found = quality.quality_columns(F.col("text"), None, None)
    return _docs(spark, sf_dir).select("doc_id", *[F.round(found[k], 9).alias(k) for k in ("readability", "ascii_letter_ratio", "space_ratio", "english_density")], found["mojibake_count"].cast("int").alias("mojibake_count"))


@query(f"SELECT doc_id, coalesce(length({sql.trim('text')}) >= 24, false) AS is_readable, CASE WHEN NOT coalesce(length({sql.trim('text')}) >= 24, false) THEN 'This TXT file does not contain readable text content.' END AS unreadable_reason FROM documents")
def readability_gate(spark, sf_dir):
    fine = text.is_readable_text(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", fine.alias("is_readable"), F.when(~fine, "This TXT file does not contain readable text content.").alias("unreadable_reason"))


@query("SELECT doc_id, doc_id % 4 = 0 AS valid, (octet_length(encode(text)) + [0, 1, 1, 3][(doc_id % 4 + 1) :: INT]) :: INTEGER AS n_bytes FROM documents")
def utf8_validity(spark, sf_dir):
    """Texts as they are, and with a lead byte, a byte that never occurs, or half a pair behind them."""
    broken = F.unhex(F.get(F.array(*map(F.lit, ("", "C3", "FF", "EDA080"))), (F.col("doc_id") % 4).cast("int")))
    rows = _docs(spark, sf_dir).select("doc_id", F.concat(F.encode("text", "UTF-8"), broken).alias("data"))
    return rows.select("doc_id", encoding.is_valid_utf8(F.col("data")).alias("valid"), F.octet_length("data").alias("n_bytes"))


@query()
def decode_candidates_best(spark, sf_dir):
    """UTF-8 bytes of documents: of all decodings tried the right one wins."""
    rows = _docs(spark, sf_dir).select("doc_id", F.encode("text", "UTF-8").alias("data"), F.lit(65001).alias("code_page"))
    return decoding.best_decoding(rows).filter("text <> ''").select("doc_id", "text", "encoding", "transform")


_PARAGRAPH = r"(?i)<p>([^<]*)</p>"


@query(f"WITH p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '{_PARAGRAPH}', 1), lambda x: {sql.entities('x')}), lambda x: {sql.trim('x')} <> '') AS ps FROM pages) SELECT page_id, {sql.clean('array_to_string(ps, chr(10) || chr(10))')} AS text, CASE WHEN len(ps) = 0 THEN 'No paragraphs detected in Word document.' ELSE '' END AS warnings FROM p")
def docx_paragraphs(spark, sf_dir):
    """Paragraphs of pages, written as a word processor's XML and read from it."""
    kept = F.regexp_extract_all("html", F.lit(_PARAGRAPH), F.lit(1))
    xml = F.array_join(F.transform(kept, lambda p: F.concat(F.lit("<w:p><w:r><w:t>"), p, F.lit("</w:t></w:r></w:p>"))), "")
    rows = table(spark, sf_dir, "pages").select("page_id", text.docx_text(xml).alias("d"))
    return rows.select("page_id", F.col("d.text").alias("text"), F.array_join("d.warnings", "; ").alias("warnings"))


@query()
def mobi_round_trip(spark, sf_dir):
    """Documents written as uncompressed book databases with one text record, and read back."""
    number = lambda c, size: F.unhex(F.lpad(F.hex(c.cast("long") if not isinstance(c, int) else F.lit(c).cast("long")), size * 2, "0"))
    zeros = lambda n: F.unhex(F.lit("00" * n))
    data = F.encode("text", "UTF-8")
    head = F.concat(number(1, 2), zeros(2), number(F.octet_length(data), 4), number(1, 2), zeros(6), F.encode(F.lit("MOBI"), "UTF-8"), number(132, 4), zeros(4), number(65001, 4), zeros(132))
    start = 78 + 16
    content = F.concat(zeros(60), F.encode(F.lit("BOOKMOBI"), "UTF-8"), zeros(8), number(2, 2), number(start, 4), zeros(4), number(start + 164, 4), zeros(4), head, data)
    books = _docs(spark, sf_dir).select("doc_id", content.alias("content"))
    return containers.mobi_documents(books).filter("text <> ''").select("doc_id", "text", "error")


# Files.


@query(f"WITH {sql.LIB} SELECT doc_id, file_name, {sql.document_format('file_name', 'mime_type')} AS format FROM nm")
def format_detection(spark, sf_dir):
    return named(spark, sf_dir).select("doc_id", "file_name", files.document_format(F.col("file_name"), F.col("mime_type")).alias("format"))


@query(f"WITH {sql.LIB} SELECT doc_id, {sql.title('file_name')} AS title, upper(string_split(file_name, '.')[-1]) AS label FROM nm")
def title_cleaning(spark, sf_dir):
    return named(spark, sf_dir).select("doc_id", text.title_of_file(F.col("file_name")).alias("title"), files.extension_label(F.col("file_name")).alias("label"))


# The library.


def _ranked_sql(order: str) -> str:
    return f"WITH {sql.LIB} SELECT doc_id, title, word_count, row_number() OVER (ORDER BY {order}, doc_id) - 1 AS rank FROM lib"


@query(_ranked_sql("updated_ts DESC"))
def library_recent(spark, sf_dir):
    return library.ranked(lib(spark, sf_dir).drop("text"), "recent").select("doc_id", "title", "word_count", "rank")


@query(_ranked_sql("title"))
def library_alpha(spark, sf_dir):
    return library.ranked(lib(spark, sf_dir).drop("text"), "alpha").select("doc_id", "title", "word_count", "rank")


@query(_ranked_sql("CASE WHEN word_count > 0 THEN chunk_index :: DOUBLE / word_count ELSE 0 END DESC"))
def library_progress(spark, sf_dir):
    return library.ranked(lib(spark, sf_dir).drop("text"), "progress").select("doc_id", "title", "word_count", "rank")


@query(f"WITH {sql.LIB} SELECT doc_id, title FROM lib WHERE contains(lower(title), 'src1')")
def library_search(spark, sf_dir):
    return library.searched(lib(spark, sf_dir), "SRC1").select("doc_id", "title")


@query(f"WITH {sql.LIB} SELECT count(*) AS files, count(*) FILTER (is_readable) AS readable_files, coalesce(sum(word_count) FILTER (is_readable), 0) :: BIGINT AS total_words FROM lib")
def library_totals(spark, sf_dir):
    return library.totals(lib(spark, sf_dir))


@query(f"WITH {sql.LIB}, r AS (SELECT *, chunk_index < word_count AS u FROM lib WHERE is_readable) SELECT doc_id, title, chunk_index, word_count FROM r ORDER BY u DESC, CASE WHEN u THEN updated_ts END DESC NULLS LAST, doc_id LIMIT 1")
def continue_reading(spark, sf_dir):
    return library.continue_reading(lib(spark, sf_dir)).select("doc_id", "title", "chunk_index", "word_count")


_MINUTES = "ceil(greatest(word_count - chunk_index, 0) / 300.0) :: BIGINT"


@query(f"""WITH {sql.LIB}, m AS (SELECT *, {_MINUTES} AS m FROM lib) SELECT doc_id, (CASE WHEN word_count = 0 THEN 0 ELSE greatest(0, least(100, floor(chunk_index :: DOUBLE / word_count * 100 + 0.5 :: DOUBLE))) END) :: BIGINT AS progress_percent,
CASE WHEN word_count = 0 THEN 'N/A' WHEN m < 1 THEN '<1 min' WHEN m < 60 THEN m || ' min' WHEN m % 60 > 0 THEN (m // 60) || 'h ' || (m % 60) || 'm' ELSE (m // 60) || 'h' END AS eta,
CASE WHEN word_count >= 1000000 THEN {sql.fixed_1('(word_count / 1e6)')} || 'M' WHEN word_count >= 1000 THEN {sql.fixed_1('(word_count / 1e3)')} || 'K' ELSE word_count :: VARCHAR END AS words FROM m""")
def card_labels(spark, sf_dir):
    return lib(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in library.card_columns().items()])


@query(f"WITH {sql.LIB} SELECT doc_id, CASE WHEN NOT is_readable THEN 'No readable text detected.' WHEN doc_id % 3 = 0 THEN 'converted' END AS message FROM lib")
def card_messages(spark, sf_dir):
    rows = lib(spark, sf_dir).withColumns({"unreadable_reason": F.lit(None).cast("string"), "conversion_warnings": F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("converted"))).otherwise(F.array().cast("array<string>"))})
    return rows.select("doc_id", library.card_message().alias("message"))


@query("WITH t AS (SELECT text, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY text) SELECT first_id, copies FROM t WHERE copies > 1")
def duplicate_texts(spark, sf_dir):
    grouped = _docs(spark, sf_dir).groupBy(F.sha2("text", 256).alias("k")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return grouped.filter("copies > 1").select("first_id", "copies")


_KEPT = f"WITH {sql.LIB}"


def _as_store(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("doc_id").cast("string").alias("id"), "title", F.col("chunk_index").cast("long").alias("chunk_index"), F.lit(0).cast("long").alias("updated_at"))


@query(_KEPT + " SELECT doc_id :: VARCHAR AS id, title, CASE WHEN doc_id % 7 = 0 THEN chunk_index + 1 ELSE chunk_index END AS chunk_index, CASE WHEN doc_id % 7 = 0 THEN 5 ELSE 0 END :: BIGINT AS updated_at FROM lib")
def update_document(spark, sf_dir):
    docs = _as_store(lib(spark, sf_dir))
    return store.updated(docs, docs.filter(F.col("id").cast("long") % 7 == 0).select("id", (F.col("chunk_index") + 1).alias("chunk_index")), F.lit(5))


@query(_KEPT + " SELECT doc_id :: VARCHAR AS id, title FROM lib WHERE doc_id % 5 <> 0")
def delete_document(spark, sf_dir):
    docs = _as_store(lib(spark, sf_dir))
    return store.without(docs, docs.filter(F.col("id").cast("long") % 5 == 0)).select("id", "title")


@query(_KEPT + " SELECT doc_id :: VARCHAR AS id, title FROM lib UNION ALL SELECT 'sample-document', 'Welcome'")
def sample_injection(spark, sf_dir):
    docs = _as_store(lib(spark, sf_dir)).select("id", "title")
    sample = spark.range(1).select(F.lit(store.SAMPLE_ID).alias("id"), F.lit(store.SAMPLE_TITLE).alias("title"))
    return store.with_sample(store.with_sample(docs, sample), sample)


# Progress.

_EVENTS = "ev AS (SELECT user_id AS doc_id, event_id, ts, event_type, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) AS chunk_index FROM events)"


@query(f"WITH {_EVENTS} SELECT doc_id, (max(struct_pack(ts := ts, e := event_id, c := chunk_index))).c AS chunk_index, max(ts) AS updated_ts FROM ev GROUP BY doc_id")
def latest_progress(spark, sf_dir):
    return progress.latest_progress(progress_events(spark, sf_dir))


@query(f"WITH {_EVENTS}, l AS (SELECT *, lag(chunk_index) OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS b FROM ev) SELECT doc_id, event_id, chunk_index FROM l WHERE chunk_index IS DISTINCT FROM b")
def saved_positions(spark, sf_dir):
    return progress.saved_positions(progress_events(spark, sf_dir)).select("doc_id", "event_id", "chunk_index")


@query(f"WITH {_EVENTS}, o AS (SELECT doc_id, chunk_index FROM ev WHERE event_type = 'click' GROUP BY ALL HAVING count(*) % 2 = 1) SELECT doc_id, string_agg(chunk_index :: VARCHAR, ',' ORDER BY chunk_index) AS bookmarks FROM o GROUP BY doc_id")
def bookmark_toggle(spark, sf_dir):
    found = progress.bookmarks(progress_events(spark, sf_dir).filter("event_type = 'click'"))
    return found.select("doc_id", F.array_join(F.col("bookmarks").cast("array<string>"), ",").alias("bookmarks"))


@query(f"WITH {_EVENTS}, l AS (SELECT *, first(chunk_index) OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS s FROM ev) SELECT doc_id, event_id, chunk_index FROM l WHERE chunk_index % 20 = 0 AND chunk_index <> s")
def checkpoint_events(spark, sf_dir):
    return progress.checkpoints(progress_events(spark, sf_dir)).select("doc_id", "event_id", "chunk_index")


@query(f"WITH {_EVENTS}, t AS (SELECT * FROM ev WHERE event_type IN ('click', 'view')), l AS (SELECT *, lag(ts) OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS b FROM t) SELECT doc_id, event_id FROM l WHERE ts - b < INTERVAL 1 HOUR")
def double_tap_pairs(spark, sf_dir):
    taps = progress_events(spark, sf_dir).filter("event_type in ('click', 'view')")
    return progress.double_tap_pairs(taps, within_ms=3_600_000).select("doc_id", "event_id")


@query(f"""WITH {_EVENTS}, t AS (SELECT * FROM ev WHERE event_type IN ('click', 'view')), l AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY doc_id ORDER BY ts, event_id) < INTERVAL 1 HOUR, false) AS close FROM t),
g AS (SELECT *, sum(CASE WHEN close THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY ts, event_id) - 1 AS number FROM g) SELECT doc_id, event_id FROM n WHERE close AND number % 2 = 1""")
def double_taps(spark, sf_dir):
    taps = progress_events(spark, sf_dir).filter("event_type in ('click', 'view')").withColumn("ts", F.col("ts").cast("timestamp"))
    return progress.double_taps(taps, within_ms=3_600_000).select("doc_id", "event_id")


@query(f"WITH w AS (SELECT doc_id, ceil(len({sql.reading_words('text')}) / 2.0) :: BIGINT AS chunks FROM documents), g AS (SELECT *, unnest([0, 1000, 60000, 600000]) :: BIGINT AS elapsed_ms FROM w WHERE chunks > 0), t AS (SELECT *, 3 + floor(elapsed_ms / (60000.0 :: DOUBLE / 300 * 2)) :: BIGINT AS t FROM g) SELECT doc_id, elapsed_ms, least(t, chunks - 1) AS chunk_index, t >= chunks AS finished, floor(least(t, chunks - 1) :: DOUBLE / chunks * 100 + 0.5 :: DOUBLE) :: BIGINT AS percent FROM t")
def playback_index(spark, sf_dir):
    # Words are counted once for each text, not again for each of its rows and each column.
    counted = computed(_docs(spark, sf_dir), chunks=reading.chunk_count(F.col("text"), 2)).filter("chunks > 0")
    rows = counted.select("doc_id", "chunks", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 1000, 60000, 600000)])).alias("elapsed_ms"))
    rows = rows.withColumns(reading.playback_index(F.lit(3), F.col("elapsed_ms"), F.lit(300), 2, F.col("chunks")))
    return rows.select("doc_id", "elapsed_ms", "chunk_index", "finished", reading.js_round(reading.reader_progress(F.col("chunk_index"), F.col("chunks"))).alias("percent"))


@query("WITH e AS (SELECT event_id, ((event_id * 37) % 161 - 80) :: BIGINT AS dx, ((event_id * 53) % 141 - 70) :: BIGINT AS dy FROM events) SELECT event_id, CASE WHEN abs(dx) < 8 AND abs(dy) < 8 THEN 'tap' WHEN abs(dx) > abs(dy) AND abs(dx) > 30 THEN CASE WHEN dx > 0 THEN 'jump-5' ELSE 'jump+5' END WHEN abs(dy) > abs(dx) AND abs(dy) > 30 THEN CASE WHEN dy > 0 THEN 'wpm-50' ELSE 'wpm+50' END ELSE 'none' END AS gesture, floor(greatest(0.0 :: DOUBLE, least((dx - 8) / 300.0 :: DOUBLE, 1.0 :: DOUBLE)) * 99 + 0.5 :: DOUBLE) :: BIGINT AS scrubbed, greatest(0, least(dx + 40, 99)) :: BIGINT AS sought FROM e")
def gestures(spark, sf_dir):
    dx, dy = (F.col("event_id") * 37) % 161 - 80, (F.col("event_id") * 53) % 141 - 70
    return table(spark, sf_dir, "events").select("event_id", reading.gesture(dx, dy).alias("gesture"), reading.scrubbed_index(dx, F.lit(300.0), F.lit(100)).alias("scrubbed"), reading.seek(dx + 40, F.lit(100)).cast("long").alias("sought"))


# Books: conversations stand for books, turns for chapters.


@query("SELECT conv_id AS doc_id, turn AS pos, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) :: BIGINT AS start_char, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) :: BIGINT AS end_char FROM conversations")
def chapter_offsets(spark, sf_dir):
    parts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "text")
    return chapters.with_offsets(parts).drop("text")


@query("SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def chapter_texts(spark, sf_dir):
    return chapters.joined_text(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "text"))


@query(f"WITH p AS (SELECT conv_id, turn, {sql.trim(sql.collapse('text'))} AS t FROM conversations) SELECT conv_id AS doc_id, {sql.trim('string_agg(t, chr(10) || chr(10) ORDER BY turn)')} AS text, string_agg('Page ' || turn || ' contains little or no selectable text.', '; ' ORDER BY turn) FILTER (length(t) < 60) AS warnings FROM p GROUP BY conv_id")
def pdf_pages(spark, sf_dir):
    items = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.lit(0).alias("item_no"), F.col("text").alias("str"))
    found = containers.pdf_documents(items, least_characters=60)
    return found.select("doc_id", "text", F.nullif(F.array_join("warnings", "; "), F.lit("")).alias("warnings"))


_SPINE = "s AS (SELECT conv_id AS doc_id, turn AS pos, role || (turn % 4) AS id, turn % 5 <> 4 AS linear FROM conversations), m AS (SELECT DISTINCT conv_id AS doc_id, role || (turn % 4) AS id, 'ch' || (turn % 4) || '.xhtml#a' AS href FROM conversations WHERE turn % 4 <> 3)"


def _spine_tables(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.concat("role", (F.col("turn") % 4).cast("string")).alias("id"), (F.col("turn") % 5 != 4).alias("linear"))
    items = rows.filter(F.col("pos") % 4 != 3).select("doc_id", "id", F.concat(F.lit("ch"), (F.col("pos") % 4).cast("string"), F.lit(".xhtml#a")).alias("href")).distinct()
    return rows, items


@query(f"WITH {_SPINE} SELECT s.doc_id, s.pos, s.id, m.href FROM s JOIN m ON s.doc_id = m.doc_id AND s.id = m.id WHERE s.linear")
def spine_manifest_join(spark, sf_dir):
    rows, items = _spine_tables(spark, sf_dir)
    return rows.filter("linear").join(items, ["doc_id", "id"]).select("doc_id", "pos", "id", "href")


@query(f"WITH {_SPINE} SELECT s.doc_id, s.pos, s.id FROM s WHERE NOT EXISTS (SELECT 1 FROM m WHERE s.doc_id = m.doc_id AND s.id = m.id)")
def unmatched_spine(spark, sf_dir):
    rows, items = _spine_tables(spark, sf_dir)
    return chapters.unmatched_spine(rows, items).select("doc_id", "pos", "id")


@query(f"WITH {_SPINE}, k AS (SELECT s.doc_id, s.pos, m.href, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.pos) AS n FROM s JOIN m ON s.doc_id = m.doc_id AND s.id = m.id WHERE s.linear), t AS (SELECT doc_id, split_part(href, '#', 1) AS h, min(struct_pack(o := pos, t := 'Part ' || pos)).t AS title FROM k WHERE pos % 2 = 0 GROUP BY 1, 2) SELECT k.doc_id, k.pos, coalesce(t.title, 'Chapter ' || k.n) AS title FROM k LEFT JOIN t ON k.doc_id = t.doc_id AND split_part(k.href, '#', 1) = t.h")
def chapter_titles(spark, sf_dir):
    rows, items = _spine_tables(spark, sf_dir)
    kept = rows.filter("linear").join(items, ["doc_id", "id"]).select("doc_id", "pos", "href")
    contents = kept.filter("pos % 2 = 0").select("doc_id", F.col("pos").alias("ord"), F.concat(F.lit("Part "), F.col("pos").cast("string")).alias("title"), "href")
    return chapters.titled(kept, contents).select("doc_id", "pos", "title")


@query(f"""WITH l AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?i)<nav[^>]*>([\\s\\S]*?)</nav>', 1), '(?i)<a[^>]*href=["''][^"'']+["''][^>]*>[\\s\\S]*?</a>') AS ls FROM pages), u AS (SELECT page_id, unnest(ls) AS a, generate_subscripts(ls, 1) AS i FROM l),
t AS (SELECT page_id, i, {sql.entities("regexp_extract(a, 'href=[\"'']([^\"'']+)[\"'']', 1)")} AS href, {sql.strip_html("regexp_extract(a, '(?i)<a[^>]*>([\\s\\S]*?)</a>', 1)")} AS title FROM u) SELECT page_id AS doc_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1) :: INTEGER AS ord, title, href FROM t WHERE title <> '' AND href <> ''""")
def toc_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return chapters.nav_contents(pages, nav=r"(?i)<nav[^>]*>([\s\S]*?)</nav>")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'OEBPS/a/' || page_id || '.xhtml' WHEN page_id % 3 = 1 THEN 'OEBPS/' || page_id || '.xhtml' ELSE page_id || '.xhtml' END AS path FROM pages""")
def resolved_paths(spark, sf_dir):
    relative = F.concat(F.when(F.col("page_id") % 3 == 0, "a/./").when(F.col("page_id") % 3 == 1, "b/../").otherwise("/"), F.col("page_id").cast("string"), F.lit(".xhtml"))
    return table(spark, sf_dir, "pages").select("page_id", chapters.resolved_path(F.lit("OEBPS/content.opf"), relative).alias("path"))


# Settings, colours and geometry: values by rule from the rows of small tables.


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 250 + n_nationkey ELSE 300 END :: INTEGER AS wpm, CASE WHEN n_nationkey % 3 = 0 THEN 40 ELSE 80 END :: INTEGER AS depth, 'cross' AS style, '#1a1a2e,#16213e' AS colours, 20 :: INTEGER AS least FROM nation")
def settings_merge(spark, sf_dir):
    wpm = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('"wpm":'), (F.col("n_nationkey") + 250).cast("string")))
    depth = F.when(F.col("n_nationkey") % 3 == 0, '"threeD":{"depth":40}')
    rows = table(spark, sf_dir, "nation").select("n_nationkey", settings.parsed(F.concat(F.lit("{"), F.concat_ws(",", wpm, depth), F.lit("}"))).alias("s"))
    return rows.select("n_nationkey", F.col("s.wpm").alias("wpm"), F.col("s.threeD.depth").alias("depth"), F.col("s.threeD.defaultStyle").alias("style"), F.array_join("s.background.gradientColors", ",").alias("colours"), F.col("s.pdf.minCharsPerPage").alias("least"))


@query("SELECT n_nationkey, greatest(50, least(n_nationkey * 100 + 50, 1200)) :: BIGINT AS wpm, greatest(1, least(n_nationkey - 1, 5)) :: BIGINT AS chunk_size, greatest(12, least(n_nationkey * 4 - 4, 48)) :: BIGINT AS font_size, ((n_nationkey * 50 + 30) % 360) :: BIGINT AS angle, floor((32 * 0.015 :: DOUBLE + n_nationkey * 2 / 50.0 :: DOUBLE * (32 * 0.08 :: DOUBLE)) * 10 + 0.5 :: DOUBLE) / 10 AS spacing FROM nation")
def settings_clamp(spark, sf_dir):
    n = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select("n_nationkey", reading.adjusted("wpm", n * 100, 1).alias("wpm"), reading.adjusted("chunkSize", n, -1).alias("chunk_size"), reading.adjusted("fontSize", n * 4, -2).alias("font_size"), reading.turned(n * 50, 2).alias("angle"), reading.letter_spacing(n * 2, F.lit(32)).alias("spacing"))


_RGB = "k AS (SELECT n_nationkey, (n_nationkey * 41) % 256 AS r, (n_nationkey * 97) % 256 AS g, (n_nationkey * 13) % 256 AS b FROM nation)"
_HEX = "'#' || printf('%02x%02x%02x', r, g, b)"


def _palette(spark, sf_dir):
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", display.colour_of(*[(n * k) % 256 for k in (41, 97, 13)]).alias("colour"))


def _linear(c: str) -> str:
    return f"(CASE WHEN {c} / 255.0 :: DOUBLE <= 0.03928 THEN {c} / 255.0 :: DOUBLE / 12.92 :: DOUBLE ELSE pow(({c} / 255.0 :: DOUBLE + 0.055 :: DOUBLE) / 1.055 :: DOUBLE, 2.4 :: DOUBLE) END)"


@query(f"WITH {_RGB}, l AS (SELECT n_nationkey, {_HEX} AS colour, {_linear('r')} * 0.2126 :: DOUBLE + {_linear('g')} * 0.7152 :: DOUBLE + {_linear('b')} * 0.0722 :: DOUBLE AS l FROM k) SELECT n_nationkey, colour, round(1.05 :: DOUBLE / (l + 0.05 :: DOUBLE), 9) AS on_white, 1.05 :: DOUBLE / (l + 0.05 :: DOUBLE) >= 4.5 AS enough FROM l")
def contrast_pairs(spark, sf_dir):
    white = F.lit("#FFFFFF")
    return _palette(spark, sf_dir).select("n_nationkey", "colour", F.round(display.contrast(F.col("colour"), white), 9).alias("on_white"), display.meets_contrast(F.col("colour"), white).alias("enough"))


@query(f"WITH {_RGB} SELECT n_nationkey, CASE WHEN (r * 0.299 :: DOUBLE + g * 0.587 :: DOUBLE + b * 0.114 :: DOUBLE) / 255 > 0.5 THEN '#000000' ELSE '#FFFFFF' END AS text_colour, '#' || printf('%02x%02x%02x', floor(least(255.0, r + r * 30 / 100.0 :: DOUBLE) + 0.5 :: DOUBLE) :: INT, floor(least(255.0, g + g * 30 / 100.0 :: DOUBLE) + 0.5 :: DOUBLE) :: INT, floor(least(255.0, b + b * 30 / 100.0 :: DOUBLE) + 0.5 :: DOUBLE) :: INT) AS gloss FROM k")
def color_math(spark, sf_dir):
    return _palette(spark, sf_dir).select("n_nationkey", display.contrast_colour(F.col("colour")).alias("text_colour"), display.gloss(F.col("colour")).alias("gloss"))


@query("SELECT n_nationkey, round(cos(n_nationkey * 15 * pi() / 180 + pi()) * 50 + 50, 6) + 0.0 AS x1, round(sin(n_nationkey * 15 * pi() / 180) * 50 + 50, 6) + 0.0 AS y2 FROM nation")
def gradient_lines(spark, sf_dir):
    points = display.gradient_points(F.col("n_nationkey") * 15)
    return table(spark, sf_dir, "nation").select("n_nationkey", (F.round(points["x1"], 6) + 0.0).alias("x1"), (F.round(points["y2"], 6) + 0.0).alias("y2"))


@query("SELECT n_nationkey AS i, round((sin(n_nationkey * 0.12345 :: DOUBLE) + 1) / 2 * 8, 9) AS cx, round((cos(n_nationkey * 0.12345 :: DOUBLE * 1.3 :: DOUBLE) + 1) / 2 * 8, 9) AS cy, round((sin(n_nationkey * 0.12345 :: DOUBLE * 2.1 :: DOUBLE) + 1) / 2 * 0.6 :: DOUBLE + 0.4 :: DOUBLE, 9) AS r FROM nation")
def noise_points(spark, sf_dir):
    rows = table(spark, sf_dir, "region").filter("r_regionkey = 0").select(F.posexplode(display.noise_points(F.lit(100))).alias("i", "p"))
    kind = table(spark, sf_dir, "nation").schema["n_nationkey"].dataType
    return rows.select(F.col("i").cast(kind).alias("i"), *[F.round(f"p.{k}", 9).alias(k) for k in ("cx", "cy", "r")])


@query("WITH t AS (SELECT n_nationkey AS n, radians(n_nationkey * 10.0 :: DOUBLE) AS a FROM nation) SELECT n AS n_nationkey, round(2 * (cos(a) * 3 - sin(a) * 4) + n, 6) + 0.0 AS x, round(3 * (sin(a) * 3 + cos(a) * 4) - n, 6) + 0.0 AS y, 3.0 :: DOUBLE AS back_x, 4.0 :: DOUBLE AS back_y FROM t")
def plane_transforms(spark, sf_dir):
    """A point moved, stretched and turned, and brought back by the inverse."""
    n = F.col("n_nationkey")
    m = display.rotated(display.scaled(display.translated(display.matrix(1, 0, 0, 1, 0, 0), n, -n), 2.0, 3.0), n * 10.0)
    there = table(spark, sf_dir, "nation").select("n_nationkey", m.alias("m")).withColumn("p", display.mapped_point(F.col("m"), F.lit(3.0), F.lit(4.0))).withColumn("back", display.mapped_point(display.inverted(F.col("m")), F.col("p.x"), F.col("p.y")))
    return there.select("n_nationkey", (F.round("p.x", 6) + 0.0).alias("x"), (F.round("p.y", 6) + 0.0).alias("y"), (F.round("back.x", 6) + 0.0).alias("back_x"), (F.round("back.y", 6) + 0.0).alias("back_y"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of one word of the readable documents, with recognition points."""
    docs = _docs(spark, sf_dir).filter(text.is_readable_text(F.col("text")))
    return chunk_rows(docs, 1).select("doc_id", "chunk_index", F.array_join("words", " ").alias("chunk"), "orp_index")
