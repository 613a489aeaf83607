"""Chat-request side: P13 request normalisation, W4 source labels, A10 context,
P12 prompt, A11 counts.

Everything is per query id over the ranked hits of ``topk_batch``; a query
has at most k hits, so the per-query assembly collects a bounded group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.functions.text import PREVIEW_SOURCES, preview, py_strip, relevance_pct

# --- fixed values -----------------------------------------------------------
DEFAULT_TOP_K_CHAT = 5
DEFAULT_TOP_K_SEMANTIC = 10
DEFAULT_KEYWORD_LIMIT = 10
ROUTES = {   # route: keys of the text in order, key and default of the number, error without a text
    "chat": (("question", "query"), "top_k", DEFAULT_TOP_K_CHAT, "Question is required"),
    "search": (("query", "keyword"), "limit", DEFAULT_KEYWORD_LIMIT, "Query is required"),
    "semantic-search": (("query",), "top_k", DEFAULT_TOP_K_SEMANTIC, "Query is required"),
}
PROMPT_HEAD = ("Tu es un assistant spécialisé dans l'analyse de conversations universitaires.\n"
               "Réponds UNIQUEMENT avec les informations du contexte. ")
PROMPT_NOT_FOUND = {
    "detailed": "Si l'info n'est pas dans le contexte, dis-le clairement.",
    "short": "Si l'info n'est pas dans le contexte, dis-le.",
}
PROMPT_ANSWER = {
    "detailed": "Réponse détaillée et structurée en français:",
    "short": "Réponse courte en français:",
}
# ----------------------------------------------------------------------------


def normalize_requests(requests: DataFrame, *, default_top_k: int = DEFAULT_TOP_K_CHAT,
                       primary: str = "question", secondary: str = "query",
                       k_col: str = "top_k", trim: bool = False) -> DataFrame:
    """text = primary if present else secondary (a NULL means the key is
    absent; '' is present and rejected), top_k default when absent; negative
    top_k is rejected.  Output (qid, question, top_k, status, error).

    The server keeps the text as sent; ``trim=True`` applies the page's
    whitespace strip first, so a whitespace-only question is rejected too."""
    cols = set(requests.columns)
    p = F.col(primary) if primary in cols else F.lit(None).cast("string")
    s = F.col(secondary) if secondary in cols else F.lit(None).cast("string")
    k = F.col(k_col).cast("long") if k_col in cols else F.lit(None).cast("long")
    text = F.coalesce(p, s, F.lit(""))
    if trim:
        text = py_strip(text)
    top_k = F.coalesce(k, F.lit(default_top_k).cast("long"))
    err = (F.when(text == "", F.lit("Question is required"))
           .when(top_k < 0, F.lit("top_k must be >= 0")))
    return requests.select(F.col("qid").cast("long").alias("qid"), text.alias("question"),
                           top_k.alias("top_k"),
                           F.when(err.isNull(), F.lit("ok")).otherwise(F.lit("rejected")).alias("status"),
                           err.alias("error"))


def route_requests(requests: DataFrame) -> DataFrame:
    """P13 for requests of all routes in one table (qid, route, any of question, query, keyword, top_k,
    limit): each route takes its own keys, default and error text.  A NULL is an absent key; the first key
    that is present decides, and an empty text is rejected.  A negative number is rejected; an unknown or NULL
    route is rejected with text and number NULL.  Output (qid, route, text, n, status, error)."""
    cols = set(requests.columns)

    def per_route(value):
        out = None
        for name, rule in ROUTES.items():
            out = (F if out is None else out).when(F.col("route") == name, value(*rule))
        return out

    def col(name, kind):
        return F.col(name).cast(kind) if name in cols else F.lit(None).cast(kind)
    text = per_route(lambda keys, n, default, error: F.coalesce(*[col(k, "string") for k in keys], F.lit("")))
    number = per_route(lambda keys, n, default, error: F.coalesce(col(n, "long"), F.lit(default).cast("long")))
    missing = per_route(lambda keys, n, default, error: F.lit(error))
    of = per_route(lambda keys, n, default, error: F.lit(f"{n} must be >= 0"))
    r = requests.select(F.col("qid").cast("long").alias("qid"), "route", text.alias("text"), number.alias("n"),
                        F.when(missing.isNull(), "Unknown route").when(text == "", missing).when(number < 0, of).alias("error"))
    return r.select("qid", "route", "text", "n", F.when(F.col("error").isNull(), "ok").otherwise("rejected").alias("status"), "error")


def sources(hits: DataFrame, corpus: DataFrame, *, text_col: str = "corpus") -> DataFrame:
    """W4 + P4a + P5: (qid, rank, id, text preview 200, relevance %).  Hits
    that already carry the text skip the join back to the corpus."""
    h = hits if text_col in hits.columns else hits.join(corpus.select("id", text_col), "id")
    return h.select("qid", "rank", "id", preview(text_col, PREVIEW_SOURCES).alias("text"),
                    relevance_pct("similarity").alias("relevance"))


def build_prompt(context, question, style: str = "detailed"):
    """P12 as a Column expression."""
    return F.concat(F.lit(PROMPT_HEAD + PROMPT_NOT_FOUND[style] + "\n\nContexte: "), context,
                    F.lit("\n\nQuestion: "), question,
                    F.lit("\n\n" + PROMPT_ANSWER[style]))


def context_prompt(hits: DataFrame, corpus: DataFrame, requests: DataFrame, *,
                   text_col: str = "corpus", style: str = "detailed") -> DataFrame:
    """A10 + P12 + A11: per query, the hit texts joined by a space in rank
    order, the prompt built from them, and the number of sources.  A query
    without hits gets an empty context.  Hits that already carry the text
    skip the join back to the corpus."""
    h = hits if text_col in hits.columns or corpus is None else hits.join(corpus.select("id", text_col), "id")
    ctx = (h.groupBy("qid")
           .agg(F.array_sort(F.collect_list(F.struct("rank", text_col))).alias("_hits"))
           .select("qid", F.array_join(F.transform("_hits", lambda x: x[text_col]), " ").alias("context"),
                   F.size("_hits").cast("long").alias("sources_count")))
    r = requests.select("qid", "question")
    out = r.join(ctx, "qid", "left")
    context = F.coalesce(F.col("context"), F.lit(""))
    return out.select("qid", "question", F.coalesce("sources_count", F.lit(0)).cast("long").alias("sources_count"),
                      context.alias("context"), build_prompt(context, F.col("question"), style).alias("prompt"))
