"""Composite plans: ingest, answer, and the adaptive, corrective, decomposed and iterative ways to answer. All take batches of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import collapse, embedding_text, stable_id
from ..functions.vectors import hashed_vectors
from ..operators import chunking, context, graph, search, sparse, tools
from ..operators import understanding as U
from ..sources import parsers
from .tables import written

CHUNKERS = {"heading_aware": chunking.heading_aware, "semantic": chunking.semantic, "proposition": chunking.propositions, "hierarchical": lambda e: chunking.hierarchical(chunking.heading_aware(e))}


@dataclass(frozen=True)
class Settings:
    """What changes results. Names and defaults are those of the engine's users.

    mode: dense, sparse, hybrid, max_sim (late interaction of tokens) or graph
    (walks over entities). quantised: the dense part is searched in int8 first
    and rescore * k candidates are ranked exactly. truncate: leading dimensions
    that vectors keep. late_chunking mixes a chunk's vector with those of its
    neighbours in the document. instruction: the task that queries, not texts,
    are embedded with. rerank_top_k: how many hits a reranker leaves, top_k if
    None.

    The last ones are a caller's models, None for the built-in steps: an
    embedder of a text column (of texts and queries, or of queries by
    query_embedder), a writer of a hypothetical passage for a query column, an
    order of a query's texts, an answer to the columns query and contexts, and
    a model that answers with tools.
    """

    chunk_strategy: str = "heading_aware"
    max_tokens: int = 180
    overlap_tokens: int = 40
    contextual: bool = False
    mode: str = "hybrid"
    fusion: str = "rrf"
    top_k: int = 5
    expand: bool = False
    reranker: str = "identity"
    mmr_lambda: float = 0.7
    process_contexts: bool = False
    dim: int = 256
    quantised: bool = False
    rescore: int = search.RESCORE
    truncate: int | None = None
    late_chunking: bool = False
    late_alpha: float = 0.3
    instruction: str | None = None
    rerank_top_k: int | None = None
    embedder: Callable[[Column], Column] | None = None
    hypothesis: Callable[[Column], Column] | None = None
    order: Callable[[str, list[str]], list[int]] | None = None
    generator: Callable[[Column, Column], Column] | None = None
    query_embedder: Callable[[Column], Column] | None = None
    tool_model: Callable[[list], tools.Turn] | None = None

    @property
    def final_k(self) -> int:
        return self.rerank_top_k or self.top_k


@dataclass
class Index:
    """Tables of one ingested batch: documents are all that could be parsed, jobs has the input's order in `ord`; the entity graph is made when it is first asked for.

    model has the batch's counts, which sparse search reads, None for an index read from a store: there it reads the postings.
    """

    chunks: DataFrame
    postings: DataFrame
    vectors: DataFrame
    jobs: DataFrame
    documents: DataFrame
    graph: tuple[DataFrame, DataFrame] | None = None
    model: sparse.Bm25 | None = None

    def entity_graph(self) -> tuple[DataFrame, DataFrame]:
        """(mentions, edges) of the chunks."""
        if self.graph is None:
            mentions, edges = graph.build(self.chunks)
            self.graph = written(mentions, "mentions"), written(edges, "edges")
        return self.graph


def vectors_of(df: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """(key, vec) by the settings' embedder, cut to the dimensions that the settings keep."""
    if settings.embedder is None:
        out = hashed_vectors(df, key, text, settings.dim)
    else:
        out = df.select(key, settings.embedder(F.col(text)).alias("vec"))
    return out if settings.truncate is None else out.select(key, V.truncated(F.col("vec"), settings.truncate).alias("vec"))


def chunk_vectors(chunks: DataFrame, text: str, settings: Settings) -> DataFrame:
    """(chunk_id, vec) of indexed chunks, mixed along the document with late chunking."""
    own = vectors_of(chunks, "chunk_id", text, settings)
    if not settings.late_chunking:
        return own
    order = Window.partitionBy("document_id").orderBy("section_ord", "chunk_ord", "chunk_id")
    placed = own.join(chunks.select("chunk_id", "document_id", F.row_number().over(order).alias("at")), "chunk_id")
    return V.late_chunked(placed, "document_id", "at", "vec", settings.late_alpha).select("chunk_id", F.col("late").alias("vec"))


def query_vectors(queries: DataFrame, settings: Settings) -> DataFrame:
    """(query_id, vec): queries with their instruction, by the query embedder if there is one; never mixed."""
    asked = queries if settings.instruction is None else queries.withColumn("query", V.instructed(F.col("query"), settings.instruction))
    return vectors_of(asked, "query_id", "query", replace(settings, embedder=settings.query_embedder or settings.embedder))


def chunk(elements: DataFrame, settings: Settings) -> DataFrame:
    if settings.chunk_strategy not in CHUNKERS:
        raise ValueError(f"unknown chunk strategy {settings.chunk_strategy}")
    if settings.chunk_strategy == "heading_aware":
        out = chunking.heading_aware(elements, settings.max_tokens, settings.overlap_tokens)
    else:
        out = CHUNKERS[settings.chunk_strategy](elements)
    if settings.contextual:
        title = parsers.titles(elements) if "level" in elements.columns else elements.select("document_id").distinct().withColumn("title", F.lit(None).cast("string"))
        out = out.join(title, "document_id", "left").withColumn("context", U.situate(F.col("title"), F.col("section_path"))).drop("title")
    return out


def index_chunks(chunks: DataFrame, settings: Settings, sources: DataFrame) -> Index:
    """Encode chunks; sources (source_id, document_id, ord, error) gives the jobs. Statistics are those of this batch; chunks and their counts are written once and read by every search.

    Postings are made of the counts where they are read, and so are plain hashed vectors, 256 numbers for each chunk; others are written.
    """
    held = written(chunks, "chunks", "zstd").withColumn("indexed", embedding_text(F.col("context"), F.col("text")))
    model = sparse.fit(held, text="indexed", name="postings")
    postings = sparse.encode(held, model, text="indexed")
    plain = settings.embedder is None and settings.truncate is None and not settings.late_chunking and V.VOCABULARY % settings.dim == 0
    vectors = sparse.dense_vectors(model, settings.dim) if plain else written(chunk_vectors(held, "indexed", settings), "vectors")
    sizes = held.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    good = F.col("error").isNull()
    jobs = sources.join(sizes, "document_id", "left").select(
        stable_id(F.col("source_id"), F.lit("job")).alias("job_id"), "source_id", F.when(good, "succeeded").otherwise("failed").alias("status"),
        F.when(good, F.col("document_id")).alias("document_id"), F.when(good, F.coalesce("chunk_count", F.lit(0))).otherwise(0).cast("long").alias("chunk_count"), "error", "ord",
    )
    documents = sources.where(good).select("document_id", "source_id").distinct()
    return Index(held, postings, vectors, jobs, documents, model=model)


def parse(sources: DataFrame) -> DataFrame:
    """Sources with their outlines, written."""
    return written(parsers.outlines(sources), "outlines")


def ingest_parsed(done: DataFrame, settings: Settings) -> Index:
    """Chunk and encode what parse() gave."""
    return index_chunks(chunk(parsers.elements_of(done), settings), settings, done.drop("parts"))


def ingest(sources: DataFrame, settings: Settings | None = None) -> Index:
    """Parse, chunk, encode. Sources that can't be parsed give failed jobs and the rest goes on."""
    return ingest_parsed(parse(sources), settings or Settings())


def ingest_plain(texts: DataFrame, id_col: str, text: str, settings: Settings | None = None) -> Index:
    """The same for plain texts, parsed by expressions."""
    settings = settings or Settings()
    doc = parsers.document_id(F.col(id_col), F.lit("text/plain"), F.lit("markdown"))
    sources = texts.select(F.col(id_col).cast("string").alias("source_id"), doc.alias("document_id"), F.monotonically_increasing_id().alias("ord"), F.lit(None).cast("string").alias("error"))
    return index_chunks(chunk(parsers.plain_elements(texts, id_col, text), settings), settings, sources)


MODES = ("dense", "sparse", "hybrid", "max_sim", "graph")


def search_once(queries: DataFrame, index: Index, settings: Settings) -> DataFrame:
    """Hits of (query_id, query) in the settings' mode; only the encoders that the mode needs are planned."""
    if settings.mode not in MODES:
        raise ValueError(f"unknown mode {settings.mode}")
    if settings.top_k < 1 or (settings.rerank_top_k or 1) < 1:
        raise ValueError("top_k and rerank_top_k must be positive")
    q = queries.select("query_id", collapse(F.col("query")).alias("query"))
    if settings.mode == "graph":
        return graph.retrieve(q, *index.entity_graph(), settings.top_k)
    if settings.mode == "max_sim":
        hits = search.max_sim(q, index.chunks, settings.top_k)
        return hits.withColumn("components", F.create_map(F.lit("maxsim"), F.col("score")))
    both = settings.mode == "hybrid"
    k = search.PREFETCH if both else settings.top_k
    s = d = None
    if settings.mode != "dense":
        if index.model is not None:
            s = search.bm25_search(q, index.model, k)
        else:
            s = search.sparse_search(sparse.encode_query(q, "query_id", "query"), index.postings, index.chunks, k)
    if settings.mode != "sparse":
        asked = query_vectors(q, settings)
        d = search.quantised_search(asked, index.vectors, k, settings.rescore) if settings.quantised else search.dense_search(asked, index.vectors, k)
    if both:
        return search.hybrid(d, s, settings.top_k, settings.fusion)
    one = s if d is None else d
    return one.withColumn("components", F.create_map(F.lit(settings.mode), F.col("score")))


def variants_of(query: Column, settings: Settings) -> Column:
    """The query and what else is asked in its place: its clauses, or a passage that a caller's model writes for it."""
    return U.expand(query) if settings.hypothesis is None else U.hypothetical(query, settings.hypothesis)


def retrieve(queries: DataFrame, index: Index, settings: Settings) -> DataFrame:
    """Search, over the variants of each query if asked for, fused by reciprocal rank; a query with one variant has its plain hits."""
    if not settings.expand:
        return search_once(queries, index, settings)
    listed = queries.withColumn("variants", variants_of(F.col("query"), settings)).select("query_id", F.size("variants").alias("n"), F.posexplode("variants").alias("variant", "query"))
    named = listed.withColumn("key", F.to_json(F.struct("query_id", "variant")))
    hits = search_once(named.select(F.col("key").alias("query_id"), "query"), index, settings).withColumnRenamed("query_id", "key")
    hits = written(hits.join(named.select("key", "query_id", "variant", "n"), "key").drop("key"), "variant-hits")
    plain = hits.where("n = 1").select("query_id", "chunk_id", "score", "rank", "components")
    fused = search.fuse_variants(hits.where("n > 1").select("query_id", "variant", "chunk_id", "rank"), settings.top_k).withColumn("components", F.create_map().cast("map<string,double>"))
    return plain.unionByName(fused.select(plain.columns))


def rerank(hits: DataFrame, queries: DataFrame, settings: Settings) -> DataFrame:
    """hits with chunk columns, reordered, rerank_top_k of each query."""
    k = settings.final_k
    if settings.order is not None:
        return search.model_rerank(hits, queries, k, settings.order)
    if settings.reranker == "identity":
        return search.identity_rerank(hits, k)
    if settings.reranker == "listwise":
        return search.listwise_rerank(hits, queries, k)
    if settings.reranker == "mmr":
        new = search.mmr_rerank(hits, queries, k, settings.mmr_lambda)
        return hits.drop("rank").join(new.select("query_id", "chunk_id", "rank", "rerank", "relevance"), ["query_id", "chunk_id"])
    raise ValueError(f"unknown reranker {settings.reranker}")


def checked(answers: DataFrame) -> DataFrame:
    """answers, which fail to be read where a citation names no context, or a context no retrieved chunk."""
    cited = F.array_except(F.transform("citations", lambda c: c["chunk_id"]), F.col("context_ids"))
    made_up = F.array_except("context_ids", F.coalesce("retrieved_ids", F.array().cast("array<string>")))
    say = lambda what, ids: F.raise_error(F.concat(F.lit(f"{what}: "), F.array_join(ids, ", "))).cast("string")
    text = F.when(F.size(cited) > 0, say("a citation names no context", cited)).when(F.size(made_up) > 0, say("a context was not retrieved", made_up)).otherwise(F.col("answer"))
    return answers.withColumn("answer", text).drop("context_ids")


def generate(hits: DataFrame, queries: DataFrame, settings: Settings, retrieved: DataFrame | None = None) -> DataFrame:
    """Answers from hits that carry chunk columns and a rank; retrieved_ids are those of `retrieved`, the ranking before a reranker.

    The built-in answer cites the contexts it quotes, a model's answer all of
    its contexts. Every citation must name a context, and every context a
    retrieved chunk: reading an answer that breaks this is an error.
    """
    contexts = hits.withColumn("position", F.col("rank")).join(queries.select("query_id", "query"), "query_id")
    if settings.process_contexts:
        contexts = context.process(contexts)
    model = settings.generator is not None or settings.tool_model is not None
    answers = context.extractive_answers(queries, contexts) if not model else context.cited_contexts(queries, contexts)
    ids = (hits if retrieved is None else retrieved).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda e: e["chunk_id"]).alias("retrieved_ids"))
    held = contexts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "text", "chunk_id"))).alias("l"))
    texts = held.select("query_id", F.transform("l", lambda e: e["text"]).alias("contexts"), F.transform("l", lambda e: e["chunk_id"]).alias("context_ids"))
    out = queries.select("query_id", "query").join(answers, "query_id").join(ids, "query_id", "left").join(texts, "query_id", "left")
    out = out.withColumn("context_ids", F.coalesce("context_ids", F.array().cast("array<string>")))
    if settings.generator is not None:
        out = out.withColumn("answer", settings.generator(F.col("query"), F.coalesce("contexts", F.array().cast("array<string>"))))
    elif settings.tool_model is not None:
        passages = F.transform(F.coalesce("contexts", F.array().cast("array<string>")), lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t))
        said = tools.tool_answers(F.concat_ws("\n\n", F.col("query"), F.array_join(passages, "\n")), settings.tool_model)
        out = out.withColumn("__said", said).withColumns({"answer": F.col("__said.text"), "tool_value": F.col("__said.value")}).drop("__said")
    return checked(out)


def answer(queries: DataFrame, index: Index, settings: Settings | None = None) -> DataFrame:
    """(query_id, query, answer, citations, retrieved_ids, contexts); retrieved_ids in the order before reranking."""
    settings = settings or Settings()
    return answer_hits(written(retrieve(queries, index, settings), "hits"), queries, index, settings)


def answer_hits(hits: DataFrame, queries: DataFrame, index: Index, settings: Settings) -> DataFrame:
    """Answers from hits that are there already."""
    return generate(rerank(search.attach(hits, index.chunks), queries, settings), queries, settings, hits)


def adaptive(queries: DataFrame, index: Index, settings: Settings | None = None) -> DataFrame:
    """Queries that need no retrieval are answered from nothing and never searched."""
    routed = queries.withColumn("route", U.route(F.col("query")))
    found = answer(routed.where("route <> 'no_retrieval'").drop("route"), index, settings)
    rest = routed.where("route = 'no_retrieval'").select("query_id", "query", F.lit("").alias("answer"))
    return found.unionByName(rest, allowMissingColumns=True).join(routed.select("query_id", "route"), "query_id")


def corrective(queries: DataFrame, index: Index, settings: Settings | None = None) -> DataFrame:
    """Answer; where the first hits are graded less than correct, from the fused hits of the query's variants."""
    settings = settings or Settings()
    first = written(search.attach(retrieve(queries, index, settings), index.chunks), "hits")
    grades = written(U.grade(queries, first), "grades")
    again = queries.join(grades.where("grade <> 'correct'"), "query_id", "left_semi")
    second = search.attach(retrieve(again, index, replace(settings, expand=True)), index.chunks)
    good = first.join(grades.where("grade = 'correct'"), "query_id", "left_semi")
    hits = good.unionByName(second, allowMissingColumns=True)
    return generate(rerank(hits, queries, settings), queries, settings, hits).join(grades, "query_id").withColumn("corrected", F.col("grade") != "correct")


def decomposed(queries: DataFrame, index: Index, settings: Settings | None = None) -> DataFrame:
    """One answer from the hits of all sub-questions, first come first; top_k for each sub-question, no reranking."""
    settings = settings or Settings()
    parts = queries.select("query_id", F.posexplode(U.decompose(F.col("query"))).alias("hop", "query"))
    named = parts.withColumn("key", F.to_json(F.struct("query_id", "hop")))
    hits = search_once(named.select(F.col("key").alias("query_id"), "query"), index, settings)
    hits = hits.join(named.select(F.col("key").alias("query_id"), F.col("query_id").alias("whole"), "hop"), "query_id").drop("query_id").withColumnRenamed("whole", "query_id")
    sizes = parts.groupBy("query_id").agg(F.count("*").alias("n"))
    once = search.first_seen(hits, ["hop", "rank"]).join(sizes, "query_id").where(F.col("position") <= F.col("n") * settings.top_k)
    return generate(search.attach(once.withColumn("rank", F.col("position")).drop("position", "n", "hop"), index.chunks), queries, settings)


def iterative(queries: DataFrame, index: Index, settings: Settings | None = None, max_hops: int = 3) -> DataFrame:
    """Search, add what is new, ask on with the terms that bridge; one answer at the end, no reranking."""
    settings = settings or Settings()
    state = queries.withColumn("vocabulary", U.vocabulary(F.col("query")))
    asking, found = queries, None
    for hop in range(max_hops):
        hits = search.attach(search_once(asking, index, settings).where("score > 0"), index.chunks).withColumn("hop", F.lit(hop))
        fresh = hits if found is None else hits.join(found, ["query_id", "chunk_id"], "left_anti")
        found = written(fresh if found is None else found.unionByName(fresh), "found")
        step = written(U.follow_up(state, found, hop, max_hops), "follow-up")
        if step.isEmpty():
            break
        asking = step.select("query_id", F.col("next_query").alias("query"))
        state = written(state.join(step.select("query_id", "bridge"), "query_id").withColumn("vocabulary", F.array_union("vocabulary", "bridge")).drop("bridge"), "state")
    once = search.first_seen(found, ["hop", "rank"])
    return generate(once.withColumn("rank", F.col("position")).drop("position"), queries, settings)
