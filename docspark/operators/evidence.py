"""Evidence rows from retrieval and outside sources, contexts and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark import profiles as P
from docspark.functions.text import is_blank, strip

TURN_STRETCH = 1000
COLUMNS = ("doc_name", "doc_type", "article_no", "article_title", "page", "text")


def law_names(question: Column, doc_names: Column, limit: int | None = None) -> Column:
    """Laws to look up: named in the question, then the documents found, else the question itself; the first ``limit`` or all."""
    found = F.transform(F.regexp_extract_all(question, F.lit(P.LAW_NAME), F.lit(0)), lambda m: F.regexp_replace(m, r"\s+", ""))
    named = F.filter(found, lambda m: ~m.isin(*P.LAW_WORDS_ALONE))
    bases = F.filter(F.transform(doc_names, lambda d: strip(F.get(F.split(d, r"[\(\[<]"), F.lit(0)))), lambda d: d != "")
    merged = F.array_distinct(F.concat(named, bases))
    return F.when(F.size(merged) > 0, merged if limit is None else F.slice(merged, 1, limit)).otherwise(F.array(question))


def _evidence(rows: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    filled = {"article_title": F.lit(""), "page": F.lit(0).cast("bigint")} | columns
    return rows.select(*keep, *[filled[c].alias(c) for c in COLUMNS])


def law_evidence(fetched: DataFrame, keep: list[str]) -> DataFrame:
    """Fetched law texts (query, text): blank and not-found ones dropped, cut to 2000 characters."""
    rows = fetched.filter(~is_blank(F.col("text")) & ~F.contains("text", F.lit(P.NOT_FOUND)))
    return _evidence(
        rows, keep, doc_name=F.concat(F.lit(P.LAW_PREFIX), "query"), doc_type=F.lit(P.LAW_TYPE), article_no=F.lit(P.LAW_ARTICLE),
        text=F.left("text", F.lit(P.LAW_CHARS)),
    )


def web_evidence(results: DataFrame, keep: list[str]) -> DataFrame:
    """Web results (title, body, url): under 50 characters dropped, cut to 1500."""
    rows = results.withColumn("joined", strip(F.concat_ws("\n", "title", "body"))).filter(F.length("joined") >= P.EVIDENCE_MIN_CHARS)
    name = F.when(F.col("title") != "", F.col("title")).otherwise(P.WEB_DEFAULT_NAME)
    return _evidence(rows, keep, doc_name=name, doc_type=F.lit(P.WEB_TYPE), article_no=F.col("url"), text=F.left("joined", F.lit(P.WEB_CHARS)))


def page_text(html: Column) -> dict[str, Column]:
    """Title and body text of a web page: scripts, styles and tags removed, blanks collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    body = F.regexp_replace(F.regexp_replace(bare, r"(?is)^.*</head>", " "), r"(?s)<[^>]*>", " ")
    return {
        "title": F.trim(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)),
        "body": F.trim(F.regexp_replace(body, r"\s+", " ")),
    }


STATUTE = (
    "articles array<struct<no:string,title:string,content:string,"
    "paragraphs:array<struct<no:string,content:string,items:array<struct<no:string,content:string>>>>>>"
)


def statute_text(articles: Column) -> Column:
    """Articles, paragraphs and items of a statute as indented lines; entries without content are left out."""

    def item(i: Column) -> Column:
        return F.concat(F.lit("    "), i["no"], F.lit("호: "), i["content"])

    def paragraph(p: Column) -> Column:
        own = F.when(p["content"] != "", F.array(F.concat(F.lit("  "), p["no"], F.lit("항: "), p["content"])))
        items = F.transform(F.filter(p["items"], lambda i: i["content"] != ""), item)
        return F.concat(F.coalesce(own, F.array().cast("array<string>")), items)

    def article(a: Column) -> Column:
        titled = F.when(a["title"] != "", F.concat(F.lit("("), a["title"], F.lit(")"))).otherwise("")
        head = F.when((a["no"] != "") & (a["no"] != "0"), F.concat(F.lit("제"), a["no"], F.lit("조"), titled)).otherwise("")
        own = F.when(a["content"] != "", F.array(strip(F.concat(head, F.lit(" "), a["content"]))))
        return F.concat(F.coalesce(own, F.array().cast("array<string>")), F.flatten(F.transform(a["paragraphs"], paragraph)))

    return F.array_join(F.flatten(F.transform(articles, article)), "\n")


def evidence_union(questions: DataFrame, retrieved: DataFrame, law: DataFrame, extra: DataFrame, placeholder_text: str = P.PLACEHOLDER) -> DataFrame:
    """question_id, place and evidence columns: retrieval, then law, then other sources.

    Each part carries ``rank``. A page or article lookup left without evidence gets a row with the placeholder text.
    """
    parts = [
        part.select("question_id", F.lit(no).alias("part"), F.col("rank").cast("bigint").alias("rank"), *COLUMNS)
        for no, part in enumerate((retrieved, law, extra))
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    bare = questions.filter(F.col("kind").isin("page_lookup", "article_lookup")).join(rows.select("question_id").distinct(), "question_id", "left_anti")
    placeholder = bare.select(
        "question_id", F.lit(3).alias("part"), F.lit(1).cast("bigint").alias("rank"), F.col("doc_name_hint").alias("doc_name"), F.lit("").alias("doc_type"),
        F.lit("").alias("article_no"), F.lit("").alias("article_title"), F.coalesce(F.get("target_pages", F.lit(0)), F.lit(0)).cast("bigint").alias("page"),
        F.lit(placeholder_text).alias("text"),
    )
    place = F.row_number().over(W.partitionBy("question_id").orderBy("part", "rank"))
    return rows.unionByName(placeholder).withColumn("place", place.cast("bigint")).drop("part", "rank")


def _blocks(rows: DataFrame, block: Column) -> DataFrame:
    """One text per question; a question has the top-k and a few outside rows, so the list stays short."""
    listed = F.array_sort(F.collect_list(F.struct("place", block.alias("block"))))
    return rows.groupBy("question_id").agg(listed.alias("b"), F.count("*").alias("n_chunks")).select(
        "question_id", "n_chunks", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context")
    )


def _labelled(*fields: tuple[str, str]) -> Column:
    lines = [F.concat(F.lit("[근거 "), F.col("place").cast("string"), F.lit("]"))]
    lines += [F.concat(F.lit(label + ": "), F.col(name).cast("string")) for label, name in fields]
    return F.concat_ws("\n", *lines, F.lit("내용:"), F.col("text"))


def build_context(rows: DataFrame) -> DataFrame:
    """Numbered evidence blocks joined by a blank line, in place order."""
    return _blocks(rows, _labelled(("문서명", "doc_name"), ("문서유형", "doc_type"), ("조문번호", "article_no"), ("조문제목", "article_title"), ("페이지", "page")))


def user_prompts(
    questions: DataFrame, rows: DataFrame, histories: DataFrame,
    history_head: str = P.HISTORY_HEAD, lookup_hint: str = P.LOOKUP_HINT, comparison_hint: str = P.COMPARISON_HINT,
) -> DataFrame:
    """Prompt per question: mode hint (``{kind}`` in that of look-ups stands for the kind), history, evidence and the question."""
    contexts = _blocks(rows, _labelled(("문서명", "doc_name"), ("조문", "article_no"), ("페이지", "page")))
    out = questions.join(contexts, "question_id", "left").join(histories, "question_id", "left")
    hint = (
        F.when(F.col("kind").isin("page_lookup", "article_lookup"), F.replace(F.lit(lookup_hint), F.lit("{kind}"), F.col("kind")))
        .when(F.col("kind") == "comparison", comparison_hint).otherwise("")
    )
    history = F.when(F.coalesce("history", F.lit("")) != "", F.concat(F.lit(history_head), "history", F.lit("\n\n"))).otherwise("")
    return out.select("question_id", F.concat(
        hint, history, F.lit("[검색된 근거]\n"), F.coalesce("context", F.lit(P.NO_EVIDENCE)), F.lit("\n\n[질문]\n"), "question"
    ).alias("prompt"))


def context_stats(contexts: DataFrame) -> DataFrame:
    chars = F.length("context").cast("bigint")
    return contexts.select(
        "question_id", "n_chunks", chars.alias("n_chars"), chars.alias("n_tokens"), F.lit(P.TOKEN_LIMIT).cast("bigint").alias("limit_tokens"),
        F.round(chars / P.TOKEN_LIMIT * 100, 1).alias("limit_pct"),
    )


def turn_positions(turns: DataFrame) -> DataFrame:
    """The turns with ``at``, their place in the conversation (from 0, by turn number, which may have gaps).

    Places are counted inside stretches of TURN_STRETCH turn numbers and summed up over the stretches, so a long conversation is
    not sorted as a whole.
    """
    rows = turns.withColumn("stretch", F.floor(F.col("turn") / TURN_STRETCH))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1))
    counts = rows.groupBy("conv_id", "stretch").agg(F.count("*").alias("n")).select("conv_id", "stretch", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(W.partitionBy("conv_id", "stretch").orderBy("turn", "role", "text"))
    return rows.withColumn("nth", nth).join(counts, ["conv_id", "stretch"]).withColumn("at", F.col("before") + F.col("nth") - 1).drop("stretch", "before", "nth")


def history(turns: DataFrame, shape: tuple[int, int, int, str]) -> DataFrame:
    """conv_id, turn, history: the turns before each turn, by position, then blank and foreign ones left out.

    Every kept turn is handed, already cut, to the positions that look back on it, so no conversation is gathered.
    """
    back, user_chars, assistant_chars, mark = shape
    turns = turn_positions(turns)
    role, content = F.trim("role"), strip(F.col("text"))
    kept = turns.select("conv_id", F.col("at").alias("from"), role.alias("role"), content.alias("content")).filter(
        F.col("role").isin("user", "assistant") & (F.col("content") != "")
    )
    limit = F.when(F.col("role") == "user", user_chars).otherwise(assistant_chars)
    cut = F.when(F.length("content") > limit, F.concat(F.left("content", limit), F.lit(mark))).otherwise(F.col("content"))
    head = F.when(F.col("role") == "user", P.USER_TURN).otherwise(P.ASSISTANT_TURN)
    handed = kept.select(
        "conv_id", F.explode(F.sequence(F.col("from") + 1, F.col("from") + back)).alias("at"), "from", F.concat(head, cut).alias("block")
    )
    gathered = handed.groupBy("conv_id", "at").agg(F.array_sort(F.collect_list(F.struct("from", "block"))).alias("b"))
    text = F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")
    return turns.select("conv_id", "turn", "at").join(gathered, ["conv_id", "at"], "left").select("conv_id", "turn", F.coalesce(text, F.lit("")).alias("history"))


def answer_routes(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """Route per question (kind, chat_response, target_pages, cache_key): chat, cache, page_lookup or search."""
    rows = questions.join(cache.select("cache_key", F.lit(True).alias("cached")), "cache_key", "left")
    route = (
        F.when((F.col("kind") == "chat") & (F.col("chat_response") != ""), "chat").when(F.col("cached"), "cache")
        .when((F.col("kind") == "page_lookup") & (F.size("target_pages") > 0), "page_lookup").otherwise("search")
    )
    return rows.withColumn("route", route).drop("cached")
