"""Line dedup by a log-template tree, in DataFrame functions only.

A line's tokens are its runs of characters other than blank, tab and carriage return;
tokens with a digit are masked as ``<*>``, unless all tokens have one.  The tree has
fixed depth: token count, then the ``DEPTH`` leading tokens (of shorter lines half of
the tokens).  Lines that a variable field among these leads to different leaves meet in
a second leaf, which has wildcards for them and goes by the next ``DEPTH`` tokens; it
counts only where its lines come from different first leaves.

A leaf holds any number of templates.  In a leaf each line keeps those tokens that most
texts share at their positions: as many as make up the ``SIMILAR`` part of the line, and
those of the same weight.  The rest are variable fields, and lines that keep the same
tokens share a template.  Unrelated lines in the leaf keep others and change nothing.

A line goes if it, masked, recurs in enough different texts, or if its template does.
The more constant words, the fewer texts are enough, as long lines do not recur by
chance (``SAME``, ``LIKE``).  It stays in the text of the lowest document id that has
it, and in copies of that text: so a passage that runs through many documents is kept
once, and exact copies of a document stay copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, fresh, pick, tidy_shuffles

DEPTH, SIMILAR, MIN_TEXTS, MIN_TOKENS = 3, 0.75, 10, 3
#: Lines of so many constant words or more go if so many different texts have them; shorter ones need ``MIN_TEXTS``.
SAME = ((20, 2), (8, 3))
#: The same for lines that share a template only.
LIKE = ((20, 3), (8, 5))
#: Bits of the filter that keeps most texts out of a shuffle: a broadcast of 4 MB at most, whatever the input.
FILTER_BITS = 1 << 25
_LINE, _TEXT = ["l1", "l2"], ["t1", "t2"]


def _hashes(names: list[str], *parts: Column) -> list[Column]:
    """128 bits in two columns that aggregate and join as plain numbers."""
    return [F.xxhash64(F.lit(k), *parts).alias(n) for k, n in enumerate(names)]


def _even(text: Column) -> Column:
    """Single blanks between tokens; most texts are so already, and plain searches are far cheaper than a pattern."""
    odd = text.contains("\t") | text.contains("\r") | text.contains("  ")
    return F.when(odd, F.regexp_replace(text, "[ \\t\\r]+", " ")).otherwise(text)


def _masked(line: Column) -> Column:
    """Tokens with digits as ``<*>``; a line that has no others stays as it is."""
    masked = F.regexp_replace(line, "[^ 0-9]*+[0-9][^ ]*+", "<*>")
    return F.when(line.rlike("[0-9]"), F.when(F.length(F.replace(F.replace(masked, F.lit("<*>"), F.lit("")), F.lit(" "), F.lit(""))) > 0, masked).otherwise(line)).otherwise(line)


def _lines(plain: DataFrame) -> DataFrame:
    """``plain`` without its text, and (at, masked, n) of every line that has enough tokens."""
    kept = [c for c in plain.columns if c != "text"]
    rows = plain.select(*kept, F.posexplode(F.split(_even(F.col("text")), "\n")).alias("at", "line"))
    rows = rows.select(*kept, "at", F.trim("line").alias("line")).where(F.instr("line", " ") > 0)
    rows = rows.select(*kept, "at", _masked(F.col("line")).alias("masked"))
    return rows.withColumn("n", F.size(F.split("masked", " "))).where(F.col("n") >= MIN_TOKENS)


def _leaves() -> tuple[Column, Column]:
    """The leaf by the leading tokens, and the one by those after them (none for lines of under four tokens)."""
    n, m = F.col("n"), F.col("masked")
    lead = F.least(F.lit(DEPTH), F.floor(n / 2).cast("int"))
    head = F.substring_index(m, " ", DEPTH)
    short = F.concat_ws(" ", F.slice(F.split(m, " "), 1, lead))
    a = F.when(n >= 2 * DEPTH, F.xxhash64(n, head)).when(n <= DEPTH, F.xxhash64(n, m)).otherwise(F.xxhash64(n, short))
    after = F.substring_index(F.substring_index(m, " ", 2 * DEPTH), " ", -DEPTH)
    rest = F.concat_ws(" ", F.slice(F.split(m, " "), lead + 1, F.lit(DEPTH)))
    b = F.when(n >= 2 * DEPTH, F.xxhash64(n, F.lit(1), after)).when(n > DEPTH, F.xxhash64(n, F.lit(1), rest))
    return a.alias("a"), b.alias("b")


def _needed(words: Column, steps: tuple, min_texts: int) -> Column:
    """The number of different texts that so many constant words must occur in to go."""
    out = F.lit(min_texts)
    for least, texts in reversed(steps):
        out = F.when(words >= least, F.lit(min(texts, min_texts))).otherwise(out)
    return out


def _growing(keys: DataFrame) -> DataFrame:
    """Keys for a join: never broadcast, as they grow with the input; dealt anew, so that Spark can split what very many rows have."""
    return keys.hint("rebalance").hint("merge")


def _legs(lines: DataFrame, *columns: str) -> DataFrame:
    """A row for each of a line's leaves, with its first leaf beside it."""
    both = F.filter(F.array("a", "b"), lambda x: x.isNotNull())
    return lines.select(*columns, "a", F.explode(both).alias("leaf")).where(F.col("leaf").isNotNull())  # as a join would add, so uses share a shuffle


def _mixed() -> Column:
    """Is it a first leaf (which is its lines' own), or does it have lines of different first leaves?"""
    return (F.min("a") != F.max("a")) | (F.min("a") == F.min("leaf"))


def _marked(rows: DataFrame, key: str, among: DataFrame) -> tuple[DataFrame, Column]:
    """``rows`` and a condition: false only for rows whose ``key`` (a hash) isn't ``among`` the keys, and for most of these.

    The keys set bits in the pieces of a bitmap.  With very many keys most bits are
    set, the condition holds for more rows, and a later exact join shuffles more.
    """
    at, bits = fresh(rows, "_piece"), fresh(rows, "_bits")  # no clash with columns of the rows
    place = F.pmod(F.col(key), F.lit(FILTER_BITS))
    bit = F.pmod(place, F.lit(1 << 15))
    found = among.groupBy(F.shiftright(place, 15).alias(at)).agg(F.bitmap_construct_agg(bit).alias(bits))
    byte = F.conv(F.hex(F.substr(F.col(bits), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    held = rows.withColumn(at, F.shiftright(place, 15)).join(F.broadcast(found), at, "left").drop(at)
    return held, F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False))


def _perhaps(rows: DataFrame, key: str, among: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` isn't ``among`` the keys."""
    held, marked = _marked(rows, key, among)
    return held.where(marked).select(*rows.columns)


def _templates(forms: DataFrame, min_texts: int) -> DataFrame:
    """(line, template, words) from distinct lines (line, a, b, texts, tokens); a line may have a template in each of its leaves."""
    least = min([t for _, t in LIKE] + [min_texts])
    legs = _legs(forms.withColumn("n", F.size("tokens")), *_LINE, "texts", "n", "tokens")
    wide = legs.groupBy("leaf").agg(F.sum("texts").alias("all"), F.max("n").alias("n"), F.count(F.lit(1)).alias("lines"), _mixed().alias("mixed"))
    wide = wide.where((F.col("all") >= _needed(F.col("n"), LIKE, min_texts)) & (F.col("lines") > 1) & F.col("mixed")).select("leaf")
    each = legs.join(_growing(wide), "leaf").select(*_LINE, "leaf", "n", "texts", F.posexplode("tokens").alias("i", "token"))
    common = each.groupBy("leaf", "i", "token").agg(F.sum("texts").alias("w")).where(F.col("w") >= least)
    held = each.select(*_LINE, "leaf", "n", "i", "token").join(common, ["leaf", "i", "token"])
    held = held.groupBy(*_LINE, "leaf", "n").agg(F.sort_array(F.collect_list(F.struct("w", "i", "token")), asc=False).alias("held"))
    rank = F.ceil(SIMILAR * F.col("n")).cast("int")
    held = held.where(F.size("held") >= rank).withColumn("least", F.get("held", rank - 1)["w"])
    held = held.withColumn("held", F.array_sort(F.transform(F.filter("held", lambda x: x["w"] >= F.col("least")), lambda x: F.struct(x["i"].alias("i"), x["token"].alias("token")))))
    words = F.size(F.filter("held", lambda x: x["token"] != "<*>"))
    return held.select(*_LINE, *_hashes(["p1", "p2"], F.col("leaf"), F.col("held")), words.alias("words")).where("words > 0")


def _gone_lines(df: DataFrame, id_col: str, text_col: str, min_texts: int) -> DataFrame:
    """(t1, t2, gone): for every text that loses lines, the positions of these."""
    plain = pick(df, doc_id=id_col, text=text_col).where("text is not null and text != ''")
    plain = plain.select("doc_id", "text", *_hashes(_TEXT, F.col("text")))
    masks = F.when(F.col("masked").contains("<*>"), F.size(F.filter(F.split("masked", " "), lambda t: t == "<*>"))).otherwise(0)
    rows = _lines(plain.drop("doc_id")).select(*_TEXT, "at", *_hashes(_LINE, F.col("masked")), *_leaves(), (F.col("n") - masks).alias("words"))
    # both uses of this read all its columns, so it is made and shuffled once
    seen = rows.groupBy(*_LINE, *_TEXT, "at").agg(*[F.first(c).alias(c) for c in ("a", "b", "words")])

    # leaves with rows enough for a line or a template to go; all other rows are done with
    busy = _legs(seen, "words").groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"), F.max("words").alias("words"), _mixed().alias("mixed"))
    busy = busy.where((F.col("rows") >= _needed(F.col("words"), SAME, min_texts)) & F.col("mixed")).select("leaf")
    some = _perhaps(_legs(seen, *_LINE, *_TEXT, "at", "b", "words"), "leaf", busy)
    some = cut_lineage(some.join(_growing(busy), "leaf").drop("leaf").distinct())

    # a line's owner: the text of the lowest id that has it
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", *_TEXT)).alias("first")
    docs = plain.groupBy(*_TEXT).agg(F.min("doc_id").alias("doc"))
    pairs = cut_lineage(some.groupBy(*_LINE, *_TEXT).agg(*[F.first(c).alias(c) for c in ("a", "b", "words")]).join(docs, _TEXT))
    lines = pairs.groupBy(*_LINE).agg(F.count(F.lit(1)).alias("texts"), first, *[F.first(c).alias(c) for c in ("a", "b", "words")])
    owner = [F.col(f"first.{c}").alias(o) for c, o in zip(_TEXT, ("o1", "o2"))]
    same = lines.where(F.col("texts") >= _needed(F.col("words"), SAME, min_texts)).select(*_LINE, *owner)

    # lines that may share a template, spelled out from one text each
    legs = _legs(lines, *_LINE, "texts", "words")
    wide = legs.groupBy("leaf").agg(F.sum("texts").alias("texts"), F.max("words").alias("words"), F.count(F.lit(1)).alias("lines"), _mixed().alias("mixed"))
    wide = wide.where((F.col("texts") >= _needed(F.col("words"), LIKE, min_texts)) & (F.col("lines") > 1) & F.col("mixed")).select("leaf")
    wanted = legs.join(_growing(wide), "leaf").select(*_LINE).distinct().join(lines.select(*_LINE, "a", "b", "texts", *owner), _LINE)
    wanted = cut_lineage(wanted)
    # of the texts that own such lines only these lines are shuffled, not the whole texts
    owned = wanted.select(*_LINE, F.col("o1").alias("t1"), F.col("o2").alias("t2"))
    key = F.xxhash64("l1", "t1").alias("own")
    spelled = _lines(_perhaps(plain.select("text", *_TEXT), "t1", owned.select("t1").distinct()))
    spelled = spelled.select(*_TEXT, *_hashes(_LINE, F.col("masked")), "masked").select("*", key)
    spelled = _perhaps(spelled, "own", owned.select(key)).join(owned.hint("merge"), [*_LINE, *_TEXT], "left_semi").dropDuplicates(_LINE).select(*_LINE, "masked")
    forms = wanted.join(spelled, _LINE).select(*_LINE, "a", "b", "texts", F.split("masked", " ").alias("tokens"))
    grouped = cut_lineage(_templates(cut_lineage(forms), min_texts))

    pattern = ["p1", "p2"]
    shared = pairs.select(*_LINE, *_TEXT, "doc").join(grouped, _LINE).groupBy(*pattern, *_TEXT).agg(F.min("doc").alias("doc"), F.first("words").alias("words"))
    shared = shared.groupBy(*pattern).agg(F.count(F.lit(1)).alias("texts"), F.first("words").alias("words"), first)
    shared = shared.where(F.col("texts") >= _needed(F.col("words"), LIKE, min_texts)).select(*pattern, *owner)
    dropped = grouped.join(shared, pattern).select(*_LINE, "o1", "o2").unionByName(same)
    gone = some.select(*_LINE, *_TEXT, "at").join(dropped, _LINE).where("t1 != o1 or t2 != o2")
    return gone.groupBy(*_TEXT).agg(F.collect_set("at").alias("gone"))


def _apply(df: DataFrame, text_col: str, gone: DataFrame) -> tuple[DataFrame, Column, Column]:
    """``df`` with the positions that go, the text that is left, and these positions (null: none).

    Most texts that lose nothing are passed on without a shuffle.
    """
    names = [fresh(df, n) for n in ("_text_key", "_text_check", "_gone")]
    text, drop = F.col(f"`{text_col}`"), F.col(f"`{names[2]}`")
    keyed = df.select("*", *_hashes(names[:2], F.coalesce(text, F.lit(""))))
    gone = cut_lineage(gone.toDF(*names))
    held, marked = _marked(keyed, names[0], gone.select(names[0]))
    out = [F.col(f"`{c}`") for c in df.columns]
    cut = held.where(marked).select(*out, *names[:2]).join(gone.hint("merge"), names[:2], "left").select(*out, drop)
    joined = cut.unionByName(held.where(~marked).select(*out, F.lit(None).cast(gone.schema[names[2]].dataType).alias(names[2])))
    # the array around the lines makes them a variable, so the text is split once
    rest = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), drop)
    left = F.transform(F.array(F.split(text, "\n")), lambda ls: F.concat_ws("\n", F.transform(rest(ls), lambda i: F.get(ls, i))))
    return joined, F.when(drop.isNull(), text).otherwise(F.get(left, F.lit(0))), drop


def dedup_lines(df: DataFrame, id_col: str, text_col: str, min_texts: int = MIN_TEXTS) -> DataFrame:
    """Drop the lines that recur, as they are or by their template.

    One row per input row: ``doc_id``, ``n_lines``, ``n_dropped``, ``kept_text``.
    Lines are split at ``\\n``; lines of fewer than ``MIN_TOKENS`` tokens are never
    dropped.  A null text has no lines and stays null, an empty one has one
    (blank) line.  Null ids own a line only if no other id has it.  Repeated
    rows count as one text.  An empty table gives no rows.
    """
    plain = pick(df, doc_id=id_col, text=text_col)
    with tidy_shuffles(df.sparkSession):
        joined, kept, drop = _apply(plain, "text", _gone_lines(plain, "doc_id", "text", min_texts))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return joined.select("doc_id", n.alias("n_lines"), F.when(drop.isNull(), 0).otherwise(F.size(drop)).cast("long").alias("n_dropped"), kept.alias("kept_text"))


def drop_recurring_lines(df: DataFrame, id_col: str, text_col: str, min_texts: int = MIN_TEXTS) -> DataFrame:
    """``df`` with its texts cut, all other columns as they were; texts of which nothing is left but blank lines are removed with their rows."""
    with tidy_shuffles(df.sparkSession):
        joined, kept, drop = _apply(df, text_col, _gone_lines(df, id_col, text_col, min_texts))
    cut = joined.select(*[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns], drop)
    return cut.where(drop.isNull() | F.col(f"`{text_col}`").rlike("\\S")).drop(drop)


def with_char_counts(df: DataFrame, text_col: str, count_col: str) -> DataFrame:
    """``df`` with ``count_col``, where it has one, set to the code points of the text; its place and type stay."""
    n = F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0))
    return df.select(*[n.cast(f.dataType).alias(f.name) if f.name == count_col else F.col(f"`{f.name}`") for f in df.schema])


def _needed_sql(words: str, steps: tuple, min_texts: int) -> str:
    return "CASE " + " ".join(f"WHEN {words} >= {n} THEN {min(t, min_texts)}" for n, t in steps) + f" ELSE {min_texts} END"


def oracle(table: str = "documents", min_texts: int = MIN_TEXTS) -> str:
    """DuckDB SQL for (doc_id, n_lines, n_dropped, n_chars, kept_sha256), over all lines and by tokens, without hashes or early filters."""
    owner = "arg_min(text, (doc IS NULL, doc, md5(text)))"
    return f"""
WITH docs AS (SELECT doc_id, text FROM {table}),
lines AS (SELECT doc_id, text, i - 1 AS pos, string_split(text, chr(10))[i] AS line
          FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM docs WHERE text IS NOT NULL AND text != '')),
clean AS (SELECT doc_id, text, pos, trim(regexp_replace(line, '[ \\t\\r]+', ' ', 'g')) AS p FROM lines),
raw AS (SELECT doc_id, text, pos, string_split(p, ' ') AS plain, list_transform(string_split(p, ' '), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS hidden FROM clean),
toks AS (SELECT doc_id, text, pos, len(plain) AS n, CASE WHEN len(list_filter(hidden, lambda t: t != '<*>')) > 0 THEN hidden ELSE plain END AS tokens FROM raw WHERE len(plain) >= {MIN_TOKENS}),
seen AS (SELECT tokens, text, n, min(doc_id) AS doc FROM toks GROUP BY ALL),
same AS (SELECT row_number() OVER () AS id, tokens, count(*) AS texts, {owner} AS owner, n, len(list_filter(tokens, lambda t: t != '<*>')) AS words,
                CASE WHEN n <= {DEPTH} THEN tokens ELSE tokens[1:least({DEPTH}, n // 2)] END AS a, CASE WHEN n > {DEPTH} THEN tokens[least({DEPTH}, n // 2) + 1:least({DEPTH}, n // 2) + {DEPTH}] END AS b
         FROM seen GROUP BY tokens, n),
holds AS (SELECT id, text, doc FROM seen JOIN same USING (tokens)),
legs AS (SELECT id, texts, n, a, 'a' AS kind, a AS leaf FROM same UNION ALL SELECT id, texts, n, a, 'b', b FROM same WHERE b IS NOT NULL),
open_ AS (SELECT kind, n, leaf FROM legs GROUP BY kind, n, leaf HAVING kind = 'a' OR min(a) != max(a)),
each_ AS (SELECT l.kind, l.n, l.leaf, l.texts, l.id, unnest(s.tokens) AS token, generate_subscripts(s.tokens, 1) AS i FROM (SELECT * FROM legs SEMI JOIN open_ USING (kind, n, leaf)) l JOIN same s USING (id)),
weights AS (SELECT kind, n, leaf, i, token, sum(texts) AS w FROM each_ GROUP BY ALL),
ranked AS (SELECT kind, n, leaf, id, i, token, w, row_number() OVER (PARTITION BY kind, id ORDER BY w DESC) AS place FROM each_ JOIN weights USING (kind, n, leaf, i, token)),
least_ AS (SELECT kind, id, w AS least FROM ranked WHERE place = CAST(ceil({SIMILAR} * n) AS BIGINT)),
held AS (SELECT kind, n, leaf, id, list((i, token) ORDER BY i) AS form, count(*) FILTER (token != '<*>') AS words FROM ranked JOIN least_ USING (kind, id) WHERE w >= least GROUP BY kind, n, leaf, id),
members AS (SELECT h.kind, h.n, h.leaf, h.form, h.words, s.text, min(s.doc) AS doc FROM held h JOIN holds s USING (id) GROUP BY ALL),
shared AS (SELECT kind, n, leaf, form, {owner} AS owner FROM members GROUP BY kind, n, leaf, form HAVING any_value(words) > 0 AND count(*) >= {_needed_sql('any_value(words)', LIKE, min_texts)}),
dropped AS (SELECT id, owner FROM held JOIN shared USING (kind, n, leaf, form) UNION ALL SELECT id, owner FROM same WHERE texts >= {_needed_sql('words', SAME, min_texts)}),
gone AS (SELECT DISTINCT t.text, t.pos FROM toks t JOIN same s USING (tokens) JOIN dropped d USING (id) WHERE t.text != d.owner),
kept AS (SELECT l.text, count(g.pos) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS kept_text
         FROM (SELECT DISTINCT text, pos, line FROM lines) l LEFT JOIN gone g ON l.text = g.text AND l.pos = g.pos GROUP BY l.text)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
       CAST(coalesce(k.n_dropped, 0) AS BIGINT) AS n_dropped, CAST(length(coalesce(k.kept_text, d.text)) AS BIGINT) AS n_chars, sha256(coalesce(k.kept_text, d.text)) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.text = k.text
"""
