"""Search, quotes and facts in texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import content, git
from ..operators import postings, search
from ..operators.evidence import contained
from ..tables import kept, settled, write
from .registry import load, query

_BLANK = r"[ \t\n\x0B\f\r]"
#: What is indexed of a text: over-long tokens out, then 32,768 characters without a token cut at the end.
_SHORT = rf"array_to_string(list_filter(regexp_extract_all({{}}, '[^ \t\n\x0B\f\r]+|{_BLANK}+'), lambda x: length(x) < 2040 OR regexp_matches(x, '^{_BLANK}')), '')"
_CUT = rf"CASE WHEN length(t) > 32768 AND NOT regexp_matches(substr(t, 32768, 2), '{_BLANK}') THEN regexp_replace(left(t, 32768), '[^ \t\n\x0B\f\r]+$', '') ELSE left(t, 32768) END"
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{M}}\p{{Nd}}]+')"
_TOKENS = f"tokens AS (SELECT doc_id, {_WORDS.format(_CUT)} AS w FROM (SELECT doc_id, {_SHORT.format("coalesce(text, '')")} AS t FROM documents))"
_WHOLE_TOKENS = f"tokens AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents)"
_EVERY = f"""
said AS (SELECT 'session' AS source_kind, doc_id AS id, 0::BIGINT AS source_row, text FROM documents
  UNION ALL SELECT 'message', conv_id, turn, text FROM conversations UNION ALL SELECT 'toolResult', page_id, 1, html FROM pages),
capped AS (SELECT source_kind, id, source_row, {_CUT} AS t FROM (SELECT * EXCLUDE text, {_SHORT.format("coalesce(text, '')")} AS t FROM said)),
every AS (SELECT source_kind, id, source_row, {_WORDS.format('t')} AS w FROM capped),
placed AS (SELECT source_kind, id, source_row, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM every)"""

#: All words of whole texts.
_WHOLE = _EVERY[: _EVERY.index("capped AS")] + f"""every AS (SELECT source_kind, id, source_row, {_WORDS.format("coalesce(text, '')")} AS w FROM said),
{_EVERY[_EVERY.index("placed AS") :]}"""


def _documents(spark, sf_dir):
    """Every searched row: documents, messages and pages."""
    docs = load(spark, sf_dir, "documents").select(F.lit("session").alias("source_kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("source_row"), "text")
    said = load(spark, sf_dir, "conversations").select(F.lit("message").alias("source_kind"), F.col("conv_id").alias("id"), F.col("turn").alias("source_row"), "text")
    pages = load(spark, sf_dir, "pages").select(F.lit("toolResult").alias("source_kind"), F.col("page_id").alias("id"), F.lit(1).cast("long").alias("source_row"), F.col("html").alias("text"))
    return docs.unionByName(said).unionByName(pages)


def _index(spark, sf_dir):
    """The posting lists of the tables as they are, made where they do not exist yet."""
    sources = [f"{sf_dir}/{t}.parquet" for t in ("documents", "conversations", "pages")]
    at = kept(spark, "postings-2", sources, lambda to: write(postings.build(_documents(spark, sf_dir)), to, ["source_kind"]))
    return postings.stored(spark, at)


def _whole_index(spark, sf_dir, *kinds):
    """The posting lists of whole texts, a table for each kind of row, made where it does not exist yet."""

    def one(kind):
        source = {"session": "documents", "message": "conversations", "toolResult": "pages"}[kind]
        texts = _documents(spark, sf_dir).where(F.col("source_kind") == kind)
        at = kept(spark, f"postings-whole-{kind}", [f"{sf_dir}/{source}.parquet"], lambda to: postings.write_whole(texts, to))
        return postings.stored(spark, at).drop("wave")

    return reduce(DataFrame.unionByName, map(one, kinds))


@query(f"WITH {_WHOLE_TOKENS} SELECT doc_id FROM tokens WHERE list_bool_or(list_transform(w, lambda x: starts_with(x, 'und'))) AND NOT list_contains(w, 'die')")
def search_match(spark, sf_dir):
    """Documents with a word that starts as asked and without an excluded one."""
    return _matching(_whole_index(spark, sf_dir, "session"), "und -die")


@query(f"""WITH {_TOKENS} SELECT doc_id FROM tokens WHERE (list_contains(w, 'with') AND list_bool_or(list_transform(w, lambda x: starts_with(x, 'ha'))))
OR (list_contains(w, 'pour') AND list_bool_or(list_transform(w, lambda x: starts_with(x, 'par'))))""")
def search_prefix_or(spark, sf_dir):
    """Two branches, the last word of each a prefix."""
    return _matching(_index(spark, sf_dir).where("source_kind = 'session'"), "with ha OR pour par")


@query(f"WITH {_WHOLE_TOKENS} SELECT doc_id FROM tokens WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' that the ') AND NOT list_contains(w, 'und')")
def search_phrase(spark, sf_dir):
    """Documents with a phrase: its words next to one another."""
    return _matching(_whole_index(spark, sf_dir, "session"), '"that the" -und')


def _matching(docs, text):
    return postings.match(docs, text).select(F.col("id").alias("doc_id"))


@query(rf"""
WITH {_EVERY}
SELECT source_kind, id, source_row, word AS token, count(*)::INT AS n, min(pos)::INT AS first, max(pos)::INT AS last, sum(pos)::BIGINT AS total FROM placed GROUP BY ALL
""")
def search_postings(spark, sf_dir):
    """Every posting list of the index, by size, ends and sum."""
    lists = _index(spark, sf_dir)
    return lists.select(
        *postings.KEY, "token", F.size("positions").alias("n"), F.array_min("positions").alias("first"), F.array_max("positions").alias("last"),
        F.aggregate("positions", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"),
    )


#: Covers of "that the" die OR with ha* -und: every operand's last place up to a row, the branch's first of these.
_COVERS = rf"""{_EVERY},
marked AS (SELECT source_kind, id, source_row, pos, word = 'die' AS die, word = 'with' AS with_, starts_with(word, 'ha') AS ha, word = 'that' AS that, word = 'the' AS the,
  word = 'und' AS und FROM placed WHERE word IN ('die', 'with', 'that', 'the', 'und') OR starts_with(word, 'ha')),
numbered AS (SELECT *, sum((die OR with_ OR ha OR that OR the)::INT) OVER w AS n, bool_or(und) OVER (PARTITION BY source_kind, id, source_row) AS bad,
  CASE WHEN the AND lag(that) OVER w AND lag(pos) OVER w = pos - 1 THEN pos - 1 END AS phrase
  FROM marked WINDOW w AS (PARTITION BY source_kind, id, source_row ORDER BY pos)),
latest AS (SELECT *, max(phrase) OVER w AS l_phrase, max(pos) FILTER (die) OVER w AS l_die, max(pos) FILTER (with_) OVER w AS l_with, max(pos) FILTER (ha) OVER w AS l_ha
  FROM numbered WINDOW w AS (PARTITION BY source_kind, id, source_row ORDER BY pos)),
begun AS (SELECT *, greatest(CASE WHEN l_phrase IS NOT NULL AND l_die IS NOT NULL THEN least(l_phrase, l_die) END,
  CASE WHEN l_with IS NOT NULL AND l_ha IS NOT NULL AND NOT bad THEN least(l_with, l_ha) END) AS first FROM latest),
fresh AS (SELECT *, lag(first) OVER (PARTITION BY source_kind, id, source_row ORDER BY pos) AS before FROM begun),
covers AS (SELECT f.source_kind, f.id, f.source_row, f.first::INT AS first, f.pos::INT AS last, (f.pos - f.first - (f.n - b.n))::INT AS gaps FROM fresh f
  JOIN numbered b ON b.source_kind = f.source_kind AND b.id = f.id AND b.source_row = f.source_row AND b.pos = f.first
  WHERE f.first IS NOT NULL AND (f.before IS NULL OR f.first > f.before))"""
_COVERED = '"that the" die OR with ha -und'


@query(f"WITH {_COVERS} SELECT * FROM covers")
def search_covers(spark, sf_dir):
    """The shortest stretches that hold a phrase and a word, or two words where another is nowhere."""
    # the last word of a branch is a prefix: here it is a whole word with its other forms
    branches = [[search.Operand("that the", phrase=True), search.Operand("die")], [search.Operand("with"), search.Operand("ha", prefix=True), search.Operand("und", excluded=True)]]
    return postings.covers(_index(spark, sf_dir), branches)


_SCORED = """
summed AS (SELECT source_kind, id, source_row, list(n * 0.1::DOUBLE / (gaps + 1)::DOUBLE ORDER BY gaps) AS terms FROM
  (SELECT source_kind, id, source_row, gaps, count(*) AS n FROM covers GROUP BY ALL) GROUP BY ALL),
scored AS (SELECT source_kind, id, source_row, round(r / (r + 1) * CASE source_kind WHEN 'session' THEN 4 WHEN 'message' THEN 1.5 ELSE 0.75 END::DOUBLE, 9) AS score
  FROM (SELECT *, list_reduce(list_concat([0.0::DOUBLE], terms), lambda a, b: a + b) AS r FROM summed))"""


@query(f"WITH {_COVERS}, {_SCORED} SELECT source_kind, id, source_row, round(score, 6) AS score FROM scored")
def search_ranked(spark, sf_dir):
    """Documents by how many stretches hold the words asked for, and how close."""
    branches = [[search.Operand("that the", phrase=True), search.Operand("die")], [search.Operand("with"), search.Operand("ha", prefix=True), search.Operand("und", excluded=True)]]
    return postings.ranked(_index(spark, sf_dir), branches).withColumn("score", F.round(F.round("score", 9), 6))


_THE = "covers AS (SELECT source_kind, id, source_row, pos AS first, pos AS last, 0 AS gaps FROM placed WHERE starts_with(word, 'the'))"
_ONE = f"""{_EVERY},
{_THE}"""
_BEST = f"""{_SCORED},
best AS (SELECT *, count(*) OVER (PARTITION BY id) AS matched_rows, row_number() OVER (PARTITION BY id
  ORDER BY score DESC, list_position(['session', 'message', 'pullRequest', 'toolCall', 'toolResult'], source_kind), source_row) AS r FROM scored)"""


@query(f"WITH {_WHOLE}, {_THE}, {_BEST} SELECT id, source_kind, source_row, round(score, 6) AS score, matched_rows FROM best WHERE r = 1")
def search_best_source(spark, sf_dir):
    """For each id found in documents, messages or pages: its best hit and the number of hits."""
    hits = _hits(_whole_index(spark, sf_dir, "session", "message", "toolResult"), "the")
    return search.best_source(hits).withColumn("score", F.round("score", 6))


def _hits(index, text):
    return postings.ranked(index, text).withColumn("score", F.round("score", 9))


#: The best cover of a page's rows is shown in 35 words, then the next best beyond these.
_SHOWN = r"""
active AS (SELECT conv_id AS id, max(turn) AS last_active_at FROM conversations GROUP BY conv_id),
page AS (SELECT id, source_kind, source_row, score, matched_rows, last_active_at FROM best LEFT JOIN active USING (id) WHERE r = 1
  ORDER BY score DESC, matched_rows DESC, last_active_at DESC NULLS FIRST, id LIMIT 50),
led AS (SELECT c.*, first_value(first) OVER w AS f1, first_value(last) OVER w AS l1 FROM covers c SEMI JOIN page USING (source_kind, id, source_row)
  WINDOW w AS (PARTITION BY source_kind, id, source_row ORDER BY gaps, first, last)),
edged AS (SELECT *, greatest(0, f1 - greatest(0, (35 - (l1 - f1 + 1)) // 2)) AS lo FROM led),
others AS (SELECT source_kind, id, source_row, lo, min({'g': gaps, 'f': first, 'l': last}) FILTER (first > lo + 34 OR last < lo) AS o FROM edged GROUP BY ALL),
wide AS (SELECT *, greatest(0, o.f - greatest(0, (35 - (o.l - o.f + 1)) // 2)) AS olo FROM others),
spans AS (SELECT source_kind, id, source_row, list_sort(list_filter([{'lo': lo, 'hi': lo + 34},
  CASE WHEN o IS NULL THEN NULL WHEN o.f > lo + 34 THEN {'lo': greatest(olo, lo + 35), 'hi': olo + 34} ELSE {'lo': olo, 'hi': least(olo + 34, lo - 1)} END], lambda s: s IS NOT NULL)) AS spans FROM wide),
pieces AS (SELECT source_kind, id, source_row, regexp_extract_all(t, '[\p{L}\p{M}\p{Nd}]+[^\p{L}\p{M}\p{Nd}]*') AS p FROM capped SEMI JOIN page USING (source_kind, id, source_row)),
words AS (SELECT source_kind, id, source_row, flatten(list_transform(spans, lambda s: p[s.lo + 1 : s.hi + 1])) AS shown FROM spans JOIN pieces USING (source_kind, id, source_row)),
split AS (SELECT *, list_transform(shown, lambda x: {'w': regexp_extract(x, '^[\p{L}\p{M}\p{Nd}]+'), 'rest': regexp_replace(x, '^[\p{L}\p{M}\p{Nd}]+', '')}) AS parts FROM words),
lit AS (SELECT *, list_transform(parts, lambda x: {'on': (LIT), 'w': x.w, 'rest': x.rest}) AS marked FROM split),
told AS (SELECT source_kind, id, source_row, len(list_filter(marked, lambda x: x.on)) AS n_on, array_to_string(shown, '') AS plain,
  array_to_string(list_transform(marked, lambda x: CASE WHEN x.on THEN '[[' || x.w || ']]' ELSE x.w END || x.rest), '') AS bright,
  2 * len(list_filter(marked, lambda x: x.on)) + 1 - (marked[1].on)::INT - (marked[-1].on AND marked[-1].rest = '')::INT AS segments FROM lit)
SELECT id, source_kind, source_row, round(score, 6) AS score, matched_rows, last_active_at,
  CASE WHEN segments > 32 OR length(plain) > 4000 THEN left(plain, 4000) ELSE bright END AS snippet FROM page LEFT JOIN told USING (source_kind, id, source_row)"""


def _page(spark, sf_dir, text):
    best = search.best_source(_hits(_index(spark, sf_dir), text))
    active = load(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").alias("last_active_at"))
    listed = search.page(best.join(active, "id", "left"), search.sort_keys("relevance", True))
    listed = settled(listed)  # a page
    spans = postings.fragments(_index(spark, sf_dir), listed, text)
    texts = _documents(spark, sf_dir).join(F.broadcast(listed.select(*postings.KEY)), postings.KEY, "left_semi")  # a page at most
    shown = listed.join(spans, postings.KEY, "left").join(texts, postings.KEY, "left")
    segments = postings.snippet(F.col("text"), F.col("spans"), text)
    marked = F.transform(segments, lambda s: F.when(s["highlighted"], F.concat(F.lit("[["), s["text"], F.lit("]]"))).otherwise(s["text"]))
    return shown.select("id", "source_kind", "source_row", F.round("score", 6).alias("score"), "matched_rows", "last_active_at", F.array_join(marked, "").alias("snippet"))


@query(f"WITH {_ONE}, {_BEST}, {_SHOWN.replace('(LIT)', "starts_with(lower(x.w), 'the')")}")
def search_page(spark, sf_dir):
    """The first page of a search by relevance, with highlighted snippets (made for the page alone)."""
    return _page(spark, sf_dir, "the")


_BOTH = f"""{_EVERY},
marked2 AS (SELECT source_kind, id, source_row, pos, word = 'that' AS a, starts_with(word, 'was') AS b FROM placed WHERE word = 'that' OR starts_with(word, 'was')),
latest2 AS (SELECT *, row_number() OVER w AS n, max(pos) FILTER (a) OVER w AS la, max(pos) FILTER (b) OVER w AS lb FROM marked2
  WINDOW w AS (PARTITION BY source_kind, id, source_row ORDER BY pos)),
fresh2 AS (SELECT *, CASE WHEN la IS NOT NULL AND lb IS NOT NULL THEN least(la, lb) END AS first FROM latest2),
begun2 AS (SELECT *, lag(first) OVER (PARTITION BY source_kind, id, source_row ORDER BY pos) AS before FROM fresh2),
covers AS (SELECT f.source_kind, f.id, f.source_row, f.first, f.pos AS last, f.pos - f.first - (f.n - b.n) AS gaps FROM begun2 f
  JOIN latest2 b ON b.source_kind = f.source_kind AND b.id = f.id AND b.source_row = f.source_row AND b.pos = f.first
  WHERE f.first IS NOT NULL AND (f.before IS NULL OR f.first > f.before))"""


@query(f"WITH {_BOTH}, {_BEST}, {_SHOWN.replace('(LIT)', "lower(x.w) = 'that' OR starts_with(lower(x.w), 'was')")}")
def search_page_of_two(spark, sf_dir):
    """A page for two words: fragments show where they stand nearest to one another."""
    return _page(spark, sf_dir, "that was")


@query(rf"""
WITH short AS (SELECT doc_id, array_to_string(list_filter(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+'), lambda x: length(x) < 2040 OR regexp_matches(x, '^{_BLANK}')), '') AS t FROM documents),
cut AS (SELECT doc_id, CASE WHEN length(t) > 32768 AND NOT regexp_matches(substr(t, 32768, 2), '{_BLANK}')
  THEN regexp_replace(left(t, 32768), '[^ \t\n\x0B\f\r]+$', '') ELSE left(t, 32768) END AS t FROM short)
SELECT doc_id, length(t)::INT AS n_chars, md5(t) AS digest FROM cut
""")
def search_cap(spark, sf_dir):
    """What is indexed of each document: length and digest of the capped text."""
    docs = load(spark, sf_dir, "documents").select("doc_id", search.cap(F.coalesce("text", F.lit(""))).alias("t"))
    return docs.select("doc_id", F.length("t").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query(rf"""
WITH said AS (SELECT conv_id, turn, conv_id || ' ' || coalesce(text, '') || ' ' || role AS t FROM conversations),
short AS (SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(t, '[^ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+'), lambda x: length(x) < 2040 OR regexp_matches(x, '^{_BLANK}')), '') AS t FROM said),
cut AS (SELECT conv_id, turn, CASE WHEN length(t) > 32768 AND NOT regexp_matches(substr(t, 32768, 2), '{_BLANK}')
  THEN regexp_replace(left(t, 32768), '[^ \t\n\x0B\f\r]+$', '') ELSE left(t, 32768) END AS t FROM short)
SELECT conv_id, turn, len(w)::INT AS n_tokens, md5(array_to_string(w, ' ')) AS digest FROM (SELECT conv_id, turn, {_WORDS.format('t')} AS w FROM cut)
""")
def search_tokens(spark, sf_dir):
    """What is indexed of each message: the tokens of its id, content and details, capped."""
    rows = load(spark, sf_dir, "conversations")
    text = search.search_text("message", {"id": F.col("conv_id"), "content": F.col("text"), "details": F.col("role")})
    words = rows.select("conv_id", "turn", search.tokens(text).alias("w"))
    return words.select("conv_id", "turn", F.size("w").alias("n_tokens"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


_SQUASH = r"""lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({}, ''), '\\[nrt]', ' ', 'g'), '\\(["\\/])', '\1', 'g'), '["“”]', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')))"""


@query(f"""
SELECT item_id, doc_id FROM (SELECT item_id, {_SQUASH.format('text')} AS quote FROM benchmark) b
JOIN (SELECT doc_id, {_SQUASH.format('text')} AS said FROM documents) d ON length(quote) >= 2 AND contains(said, quote)
""")
def quote_check(spark, sf_dir):
    """Which passages are really in which documents."""
    quotes = load(spark, sf_dir, "benchmark").select("item_id", content.squash(F.col("text")).alias("quote")).where(F.length("quote") >= content.QUOTE_MIN)
    said = load(spark, sf_dir, "documents").select("doc_id", content.squash(F.col("text")).alias("said"))
    return contained(quotes, "quote", said, "said", ["doc_id"]).select("item_id", "doc_id")


_SPACES = "' ' || chr(9) || chr(10) || chr(13)"
_NAME_CHARS = "'abcdefghijklmnopqrstuvwxyz0123456789_:-'"


#: A value stands between quote marks behind a name and =; it is local unless it starts with a scheme, // or #.
@query(f"""
WITH cut AS (SELECT page_id, string_split(replace(html, chr(39), chr(34)), chr(34)) AS p FROM pages),
ends AS (SELECT page_id, list_transform(range(1, len(p) - 1), lambda i: {{'before': rtrim(lower(p[i]), {_SPACES}), 'value': p[i + 1]}}) AS e FROM cut),
named AS (SELECT page_id, list_transform(list_filter(e, lambda x: ends_with(x.before, '=')), lambda x: {{'name': rtrim(left(x.before, length(x.before) - 1), {_SPACES}), 'value': x.value}}) AS e FROM ends),
ours AS (SELECT page_id, list_filter(e, lambda x: len(list_filter(['src', 'href', 'poster'], lambda n: ends_with(x.name, n)
  AND (length(x.name) = length(n) OR strpos({_NAME_CHARS}, substr(x.name, length(x.name) - length(n), 1)) = 0))) > 0) AS e FROM named),
local AS (SELECT page_id, list_filter(list_transform(e, lambda x: x.value), lambda v: NOT starts_with(v, '//') AND NOT starts_with(v, '#') AND NOT (strpos(v, ':') > 1
  AND strpos('abcdefghijklmnopqrstuvwxyz', lower(left(v, 1))) > 0 AND translate(lower(split_part(v, ':', 1)), 'abcdefghijklmnopqrstuvwxyz0123456789+.-', '') = '')) AS v FROM ours),
plain AS (SELECT page_id, list_filter(list_transform(v, lambda x: url_decode(replace(split_part(split_part(x, '?', 1), '#', 1), '+', '%2B'))), lambda x: x <> '') AS v FROM local)
SELECT page_id, array_to_string(list_transform(list_filter(range(1, len(v) + 1), lambda i: list_position(v, v[i]) = i), lambda i: v[i]), ' ') AS refs FROM plain
""")
def url_references(spark, sf_dir):
    """Local files that the attributes of a page refer to."""
    pages = load(spark, sf_dir, "pages")
    # brackets of Markdown mean nothing in these pages
    return pages.select("page_id", F.array_join(content.references(F.translate("html", "[]", "")), " ").alias("refs"))


_OUTPUT = """'hook ok' || chr(10) || '[feat/x-' || o_custkey || CASE WHEN o_orderstatus = 'P' THEN ' (root-commit)' ELSE '' END || ' ' || substr(sha256(o_orderkey::VARCHAR), 1, 9)
|| '] Close ' || o_orderpriority || chr(10) || ' 2 files changed, ' || o_custkey || ' insertions(+)' || chr(10) || 'https://git.example/acme/app/pull/' || o_orderkey"""


@query(f"""
SELECT o_orderkey, 'feat/x-' || o_custkey AS branch, substr(sha256(o_orderkey::VARCHAR), 1, 9) AS sha, 'Close ' || o_orderpriority AS subject,
  2 AS files_changed, o_custkey::INT AS insertions, 'git.example/acme/app#' || o_orderkey AS pr FROM orders
""")
def commit_facts(spark, sf_dir):
    """Commit and pull request facts read from the output of commands."""
    said = load(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_OUTPUT.replace('::VARCHAR', '')} AS output".replace("sha256(o_orderkey)", "sha2(cast(o_orderkey as string), 256)"))
    c, p = F.col("c"), F.col("p")
    facts = said.select("o_orderkey", git.commit_facts(F.col("output")).alias("c"), F.element_at(git.pull_requests(F.col("output")), 1).alias("p"))
    return facts.select(
        "o_orderkey", c["branch"].alias("branch"), c["sha"].alias("sha"), c["subject"].alias("subject"), c["files_changed"].alias("files_changed"),
        c["insertions"].alias("insertions"), F.concat(p["host"], F.lit("/"), p["owner"], F.lit("/"), p["repo"], F.lit("#"), p["number"]).alias("pr"),
    )
