"""From query texts to the items of a response: features, channels, pool, selection, assembly.

All queries of a job are one table. Recall cuts each query to a pool of POOL_SIZE items at most; what follows sees those
alone, so a fold over a query's pool is bounded by that parameter.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions import text as X
from engram.operators import cards as card_ops
from engram.operators import extraction, rendering, retrieval, selection, store
from engram.operators.rendering import strip

# What a query's anchors are, their kinds in the index, budgets.
ISSUE_ANCHOR = extraction.ISSUE
PATH_ANCHOR = r"(?<![\w./\\-])((?:[A-Za-z0-9_.+-]+[/\\])*[A-Za-z0-9_.+-]+\.(?:" + extraction._EXTENSIONS + r"|gradle|mod|lock))(?![A-Za-z0-9_])(?::(\d+))?"
SYMBOL_ANCHOR = r"\b(?:def|class|function|func|struct|interface)\s+([A-Za-z_][A-Za-z0-9_]*)"
QUOTED_ANCHOR = r"`([^`\n]{2,80})`"
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_.]{2,60}$"
EDGES = r"""(?U)^[\s.,:;()\[\]{}'"]+|[\s.,:;()\[\]{}'"]+$"""
MOST_ANCHORS = 12
ENTITY_KINDS = ("path", "symbol", "error", "test_name", "config_key")
ANCHOR_KINDS = {"path": "file", "symbol": "symbol", "error": "error", "test_name": "test_name", "issue": "issue", "config_key": "config"}
TOKEN_TARGET, LEAST_BODY_PAST_TARGET, LEAST_BODY = 64_000, 40, 1
EVIDENCE_KINDS = ("code", "command", "test_result", "stack", "log", "diff")
STRONG_LINE = r"(?m)^\s*(FAILED|E\s+|\d+\s+(passed|failed))"
TAGGED = "array<struct<kind:string,value:string>>"


def _once(found: Column) -> Column:
    """Values of a kind once whatever their case, the first as written."""
    same = lambda a, b: (a["kind"] == b["kind"]) & (F.lower(a["value"]) == F.lower(b["value"]))
    return F.aggregate(found, F.array().cast(TAGGED), lambda out, x: F.when(F.exists(out, lambda o: same(o, x)), out).otherwise(F.concat(out, F.array(x))))


def _telling(found: Column) -> Column:
    return F.filter(found, lambda e: ~X.is_junk_entity(e["kind"], e["value"]))


def anchors(text: Column, entities: Column) -> Column:
    """(kind, value): a query's entities, issue numbers, code paths, defined and quoted names; junk goes, MOST_ANCHORS of a kind."""
    all_ = lambda pattern: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern), F.lit(1))
    tag = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    quoted = F.filter(F.transform(all_(QUOTED_ANCHOR), strip), lambda v: v.rlike(IDENTIFIER))
    found = F.concat(entities, tag("issue", F.transform(all_(ISSUE_ANCHOR), lambda n: F.concat(F.lit("#"), n))), tag("path", all_(PATH_ANCHOR)), tag("symbol", all_(SYMBOL_ANCHOR)), tag("symbol", quoted))
    found = F.transform(found, lambda a: F.struct(a["kind"].alias("kind"), F.regexp_replace(a["value"], EDGES, "").alias("value")))
    return extraction.capped(_once(_telling(F.filter(found, lambda a: a["value"] != ""))), MOST_ANCHORS)


def anchor_terms(found: Column) -> Column:
    """anchors() in the kinds of the anchor index; a path tells its first two parts as a module too."""
    kinds = F.create_map(*[F.lit(x) for kv in ANCHOR_KINDS.items() for x in kv])
    own = F.transform(found, lambda a: F.struct(F.coalesce(kinds[a["kind"]], a["kind"]).alias("kind"), a["value"].alias("value")))
    parts = lambda v: F.filter(F.split(F.replace(v, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    paths = F.filter(found, lambda a: (a["kind"] == "path") & (F.size(parts(a["value"])) >= 2))
    modules = F.transform(paths, lambda a: F.struct(F.lit("module").alias("kind"), F.array_join(F.slice(parts(a["value"]), 1, 2), "/").alias("value")))
    return F.array_distinct(F.concat(own, modules))


def features(queries: DataFrame, denoise: bool = True) -> DataFrame:
    """queries: scope, query_id, text, and optionally options (array of texts). Adds probe (the text without noise, or as it is where
    little is left), terms, entities, anchors, and of the options option_terms and option_entities. Texts and index go through the
    same extractors, so both speak of the same tokens."""
    options = F.col("options") if "options" in queries.columns else F.lit(None).cast("array<string>")
    joined = F.array_join(F.transform(F.coalesce(options, F.array().cast("array<string>")), lambda o: strip(X.strip_option(o))), "\n")
    rows = queries.withColumn("probe", X.denoised_or_raw(F.col("text")) if denoise else F.coalesce("text", F.lit(""))).withColumn("option_text", joined)
    rows = rows.withColumns({"tokens": X.term_counts(F.col("probe"))["terms"]["term"], "option_tokens": X.term_counts(F.col("option_text"))["terms"]["term"]})
    content = X.content_tokens(F.col("tokens"))
    entities = lambda c: _once(_telling(extraction.entities(F.col(c), F.lit(True))))
    rows = rows.withColumns({
        "terms": F.when(F.size(content) > 0, content).otherwise(F.col("tokens")), "entities": entities("probe"), "option_entities": entities("option_text"),
        "option_terms": F.when(F.size(X.content_tokens(F.col("option_tokens"))) > 0, X.content_tokens(F.col("option_tokens"))).otherwise(F.col("option_tokens"))})
    return rows.withColumn("anchors", anchors(F.col("probe"), F.col("entities"))).drop("tokens", "option_tokens", "option_text")


def _values(rows: DataFrame, column: str) -> DataFrame:
    """scope, query_id, value of the entities of the kinds that are searched."""
    return rows.select("scope", "query_id", F.explode(column).alias("e")).where(F.col("e")["kind"].isin(*ENTITY_KINDS)).select("scope", "query_id", F.col("e")["value"].alias("value"))


def channels(asked: DataFrame, faces: DataFrame, entities: DataFrame, anchor_index: DataFrame, items: DataFrame, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None,
             fields: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """asked: features(). faces: index_face(); entities and anchor_index: scope, item_id, kind, value; items: scope, item_id; vectors:
    scope, item_id, vec; query_vectors: scope, query_id, qvec. Scores by channel; the vector channel is absent without vectors."""
    asked = retrieval.kept(asked)
    terms = lambda column, boosted=None: retrieval.query_terms(asked, fields, terms=column, boosted=boosted)
    # The texts' and the options' terms go through the index in one pass, as queries of their own.
    both = terms("terms", "anchors").withColumn("query_id", F.struct("query_id", F.lit(False).alias("option")))
    both = both.unionByName(terms("option_terms").withColumn("query_id", F.struct("query_id", F.lit(True).alias("option"))))
    scored = retrieval.kept(retrieval.bm25(faces, both))
    of = lambda option: scored.where(F.col("query_id")["option"] == option).withColumn("query_id", F.col("query_id")["query_id"])
    anchored = asked.select("scope", "query_id", F.explode(anchor_terms(F.col("anchors"))).alias("a")).select("scope", "query_id", "a.kind", "a.value")
    out = {
        "field": of(False), "entity": retrieval.entity_hits(entities, _values(asked, "entities")), "anchor": retrieval.anchor_scores(anchor_index, anchored, items),
        "options_field": of(True), "options_entity": retrieval.entity_hits(entities, _values(asked, "option_entities"))}
    if vectors is not None and query_vectors is not None:
        out["vector"] = retrieval.vector_scores(vectors, query_vectors)
    return out


def pool(asked: DataFrame, scored: dict[str, DataFrame], items: DataFrame, most: int = retrieval.POOL_SIZE) -> DataFrame:
    """query_id, item_id, rank, score, ranks: the channels fused, items that no channel found filled in with 0 up to the pool's
    size, boosts added (items may tell has_patch and has_files), the best `most` in order. items is in order of `newness`, where it
    has such a column, for the filling in."""
    fused = retrieval.fuse(retrieval.rank_lists(scored))
    fill = retrieval.fill_items(asked.select("scope", "query_id"), items, most)
    both = fused.join(fill.select("query_id", "item_id"), ["query_id", "item_id"], "full").withColumn("fused", F.coalesce("fused", F.lit(0.0)))
    cut = retrieval.top(both, ["query_id"], most, score="fused").drop("rank")
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)) if name in items.columns else F.lit(False)
    told = items.select("item_id", flag("has_patch").alias("_patch"), flag("has_files").alias("_files")).dropDuplicates(["item_id"])
    boosted = cut.join(told, "item_id", "left")
    score = F.col("fused") + retrieval.boost(F.coalesce("ranks", F.create_map().cast("map<string,int>")), F.coalesce("_patch", F.lit(False)), F.coalesce("_files", F.lit(False)))
    return retrieval.top(boosted.withColumn("score", score), ["query_id"], most).select("query_id", "item_id", "rank", "score", "ranks")


PICK = "struct<rank:int,print:string,tokens:int,files:array<string>>"


def selected(ranked: DataFrame, limit: int, target: int = TOKEN_TARGET, after: int = 2) -> DataFrame:
    """ranked: query_id, item_id, rank, files, text (at most a pool of each query). What a response or a judge chooses from: equal
    texts once, items that share a file with the picked ones behind those that don't (beyond the first `after`), bodies of few tokens only
    until `target` tokens are picked. Adds position. Dropped items don't appear."""
    rows = ranked.where(F.col("rank") <= retrieval.POOL_SIZE)
    pick = F.struct(F.col("rank").cast("int").alias("rank"), selection.fingerprint(F.col("text")).alias("print"), X.token_estimate(F.col("text")).alias("tokens"), F.coalesce("files", F.array().cast("array<string>")).alias("files"))
    none = F.array().cast(f"array<{PICK}>")

    def added(state: Column, r: Column) -> Column:
        """The state with r picked, or as it is."""
        caps = selection.tier_cap(F.size(state["picked"]) + 1)
        ok = (F.size(state["picked"]) < limit) & ~F.exists(state["picked"], lambda p: p["print"] == r["print"]) & ((state["used"] < target) | (r["tokens"] >= LEAST_BODY_PAST_TARGET))
        return F.when(ok, F.struct(F.concat(state["picked"], F.array(r)).alias("picked"), state["late"].alias("late"), F.array_union(state["seen"], r["files"]).alias("seen"), (state["used"] + F.least(r["tokens"], caps)).alias("used"))).otherwise(state)

    def step(state: Column, r: Column) -> Column:
        waits = (F.size(state["picked"]) >= after) & F.arrays_overlap(r["files"], state["seen"]) & (F.size(state["picked"]) < limit)
        late = F.struct(state["picked"].alias("picked"), F.concat(state["late"], F.array(r)).alias("late"), state["seen"].alias("seen"), state["used"].alias("used"))
        return F.when(waits, late).otherwise(added(state, r))

    start = F.struct(none.alias("picked"), none.alias("late"), F.array().cast("array<string>").alias("seen"), F.lit(0).alias("used"))
    per = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(pick)).alias("rows"))
    per = per.select("query_id", F.aggregate("rows", start, step).alias("state"))
    per = per.select("query_id", F.aggregate("state.late", F.col("state"), added, lambda s: F.transform(s["picked"], lambda p: p["rank"])).alias("order"))
    places = per.select("query_id", F.posexplode("order").alias("at", "rank")).select("query_id", "rank", (F.col("at") + 1).cast("int").alias("position"))
    return ranked.join(places, ["query_id", "rank"])


def snippets(cards: DataFrame, chunks: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """cards: query_id, item_id, source_ids; chunks: chunk_id, kind, text; asked: features(). query_id, item_id, evidence: up to k openings
    of 200 characters of a card's own chunks that show work and bear on the query, best first. A chunk bears on it by an anchor, a
    test's outcome, or two of its terms."""
    words = asked.select("query_id", "terms", F.transform("anchors", lambda a: F.lower(a["value"])).alias("names"))
    rows = cards.select("query_id", "item_id", F.posexplode("source_ids").alias("at", "chunk_id")).join(chunks.select("chunk_id", "kind", strip(F.col("text")).alias("text")), "chunk_id").join(words, "query_id")
    low = F.lower("text")
    rows = rows.where(F.col("kind").isin(*EVIDENCE_KINDS) & (F.length("text") >= 40)).withColumn("strong", F.col("text").rlike(STRONG_LINE))
    rows = rows.withColumn("lexical", F.size(F.filter("terms", lambda t: low.contains(t)))).withColumn("exact", F.size(F.filter("names", lambda n: low.contains(n))))
    rows = rows.where((F.col("exact") > 0) | F.col("strong") | (F.col("lexical") >= 2))
    score = (F.col("lexical") + 4.0 * F.col("exact") + F.when(F.col("strong"), 2.0).otherwise(0.0)) / (1.0 + F.length("text") / 2000.0)
    opening = F.substring(F.regexp_replace(low, r"(?U)\s+", " "), 1, 80)
    rows = rows.withColumn("score", score).withColumn("opening", opening)
    once = rows.groupBy("query_id", "item_id", "opening").agg(F.min_by(F.struct("score", "at", "text"), "at").alias("r"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("r")["score"]).alias("s"), F.col("r")["at"].alias("at"), F.substring(F.col("r")["text"], 1, 200).alias("text")))), 1, k)
    return once.groupBy("query_id", "item_id").agg(F.transform(best, lambda x: x["text"]).alias("evidence"))


VERDICT_OF = "struct<position:int,score:double,small:boolean,content:string,body:int,tokens:int,cap:int,hint:string>"


def assembled(chosen: DataFrame, cap: int = selection.TOKEN_CAP, ratio: float = selection.SCORE_RATIO, least: float = 0.0, least_items: int = selection.LEAST_ITEMS, least_body: int = LEAST_BODY) -> DataFrame:
    """chosen: query_id, item_id, position, score, and optionally allow_patch, hint, idea (an idea-level card has no seat by right) and
    the columns of rendering.CARD. The response: query_id, item_id, place, content, score, and outcome for items that stay out
    (low_score, budget, empty) with no place.

    Each item is rendered under its place's cap less its hint; one that doesn't fit into what is left is rendered again for what is left,
    and passed over if even that is too much, so that a later, shorter one may still fit."""
    column = lambda name, other: F.coalesce(F.col(name), other) if name in chosen.columns else other
    rows = chosen.withColumn("_hint", column("hint", F.lit(""))).withColumn("_idea", column("idea", F.lit(False))).withColumn("_allow", column("allow_patch", F.lit(True)))
    rows = rows.withColumn("_hint_tokens", X.token_estimate(F.col("_hint")))
    rows = selection.floor_of(rows, ratio, least).withColumnRenamed("floor", "_floor")
    tier = selection.tier_cap(F.col("position"))

    def rendered(these: DataFrame, room: Column) -> DataFrame:
        out = rendering.rendered(these, F.greatest(F.lit(0), room - F.col("_hint_tokens")), F.col("_allow"))
        bare = F.col("content")
        return out.withColumn("_body", rendering.body_tokens(bare)).withColumn("content", F.when(strip(bare) != "", F.concat(bare, "_hint")).otherwise(F.lit(""))).withColumn("_tokens", X.token_estimate(F.col("content")))

    rows = retrieval.kept(rendered(rows, F.least(tier, F.lit(cap))))

    def outcome(state: Column, r: Column) -> Column:
        low = (r["idea"] | (state["emitted"] >= least_items)) & (r["score"] < r["floor"])
        return F.when(low, "low_score").when(state["used"] >= cap, "budget").when(r["tokens"] == 0, "empty").when(r["body"] < least_body, "budget").when(state["used"] + r["tokens"] > cap, "tight").otherwise("in")

    def step(state: Column, r: Column) -> Column:
        said = outcome(state, r)
        goes = said == "in"
        out = F.struct(r["position"].alias("position"), F.when(state["stopped"], F.lit("later")).otherwise(said).alias("outcome"), state["used"].alias("used"))
        stopped = state["stopped"] | (said == "tight")
        return F.struct(F.when(goes & ~stopped, state["used"] + r["tokens"]).otherwise(state["used"]).alias("used"), F.when(goes & ~stopped, state["emitted"] + 1).otherwise(state["emitted"]).alias("emitted"),
                        stopped.alias("stopped"), F.concat(state["out"], F.array(out)).alias("out"))

    def folded(these: DataFrame) -> DataFrame:
        """Each row with its outcome, up to and with the first that is too long for what is left; `later` beyond that."""
        item = F.struct("position", F.col("score").alias("score"), F.col("_floor").alias("floor"), F.col("_idea").alias("idea"), F.col("_body").alias("body"), F.col("_tokens").alias("tokens"))
        start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("emitted"), F.lit(False).alias("stopped"), F.array().cast("array<struct<position:int,outcome:string,used:int>>").alias("out"))
        told = these.groupBy("query_id").agg(F.explode(F.aggregate(F.array_sort(F.collect_list(item)), start, step, lambda s: s["out"])).alias("o"))
        return these.join(told.select("query_id", F.col("o")["position"].alias("position"), F.col("o")["outcome"].alias("outcome"), F.col("o")["used"].alias("_used")), ["query_id", "position"])

    rows = rows.withColumn("position", F.col("position").cast("int"))
    done = retrieval.kept(folded(rows))
    # Where the whole cap binds, the item at the edge is made shorter and the fold goes on; each round settles one more place.
    while done.where("outcome = 'tight'").limit(1).count():
        tight = done.where("outcome = 'tight'").select("query_id", "position", "_used")
        edge = rows.join(tight, ["query_id", "position"])
        kind = rows.schema
        edge = rendered(edge.drop("content", "_body", "_tokens"), F.lit(cap) - F.col("_used"))
        fits = F.col("_used") + F.col("_tokens") <= cap
        edge = edge.withColumn("_tokens", F.when(fits, F.col("_tokens")).otherwise(F.lit(-1))).withColumn("_body", F.when(fits, F.col("_body")).otherwise(F.lit(-1))).select(*kind.names)
        rows = retrieval.kept(rows.join(tight, ["query_id", "position"], "left_anti").select(*kind.names).unionByName(edge))
        done = retrieval.kept(folded(rows))
    seat = F.sum((F.col("outcome") == "in").cast("int")).over(selection.Window.partitionBy("query_id").orderBy("position"))
    inside = F.col("outcome") == "in"
    return done.select("query_id", "item_id", F.when(inside, seat).alias("place"), F.when(inside, F.col("content")).alias("content"), F.round("score", 6).alias("score"), "outcome")


def drop_counts(ranked: DataFrame, chosen: DataFrame, response: DataFrame) -> DataFrame:
    """Per query: pooled, chosen, emitted items, and those dropped in selection, below the floor, for the budget, and empty."""
    per = lambda rows, name: rows.groupBy("query_id").agg(F.count("*").alias(name))
    said = response.groupBy("query_id").agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("in", "emitted"), ("low_score", "low_score"), ("budget", "over_budget"), ("empty", "empty"))])
    out = per(ranked, "pooled").join(per(chosen, "chosen"), "query_id", "left").join(said, "query_id", "left").na.fill(0)
    return out.withColumn("not_chosen", F.col("pooled") - F.col("chosen"))


def materialised(ranked: DataFrame, cards: DataFrame, chunks: DataFrame) -> DataFrame:
    """ranked: query_id, item_id, rank, score; cards: item_id, payload (JSON), created_at; chunks: chunk_id, text. The pool's items with the columns of
    their cards and `cited` (chunk_id to text); items without a card, or whose payload is no JSON object, go. Payloads and chunks
    are read for the pool alone, each once, however many queries found it."""
    few, _ = retrieval.small(ranked.select("item_id").distinct())
    held = cards.join(few, "item_id", "left_semi").where(F.try_parse_json("payload").isNotNull() & F.col("payload").rlike(r"^\s*\{"))
    held = retrieval.kept(held.select("item_id", "created_at", store.from_payload(F.col("payload")).alias("c")).select("item_id", "created_at", "c.*"))
    wanted, _ = retrieval.small(held.select(F.explode("source_ids").alias("chunk_id")).distinct())
    cited = held.select("item_id", F.explode("source_ids").alias("chunk_id")).join(chunks.select("chunk_id", "text").join(wanted, "chunk_id", "left_semi"), "chunk_id")
    cited = cited.dropDuplicates(["item_id", "chunk_id"]).groupBy("item_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunk_id", "text")))).alias("cited"))
    return ranked.join(held, "item_id").join(cited, "item_id", "left")


def respond(queries: DataFrame, index: dict[str, DataFrame], cards: DataFrame, top_k: int = 10, query_vectors: DataFrame | None = None, verdicts: DataFrame | None = None, pending: DataFrame | None = None) -> DataFrame:
    """From queries (scope, query_id, text, options) to responses: query_id, item_id, place, content, score. index: faces, entities, anchor_index, items,
    vectors, as channels() takes them; cards: item_id, text (the stored rendering, by which equal cards count once), files and columns
    of rendering.CARD; verdicts: query_id, item_id, verdict, confidence, where a judge has spoken; pending: as with_pending takes it.
    Without a judge, vectors or pending sessions that step leaves the order as it is."""
    asked = retrieval.kept(features(queries))
    shown = max(0, min(top_k, 100, 10))
    ranked = retrieval.kept(pool(asked, channels(asked, query_vectors=query_vectors, **index), index["items"]))
    few, _ = retrieval.small(ranked.drop("ranks"))
    chosen = selected(cards.join(few, "item_id"), limit=min(retrieval.POOL_SIZE, max(shown, selection.RERANK_CANDIDATES)))
    if verdicts is not None:
        chosen = selection.judged(chosen, verdicts).drop("verdict")
        chosen = retrieval.top(chosen.drop("rank", "position"), ["query_id"], shown).withColumnRenamed("rank", "position")
    final = chosen.where(F.col("position") <= shown)
    asked_anchors = asked.select("query_id", F.col("anchors").alias("_anchors"))
    if {"files", "problem", "patch"} <= set(cards.columns):
        final = final.join(asked_anchors, "query_id").withColumn("allow_patch", card_ops.shows_patch(F.col("_anchors"), F.col("files"), F.col("problem"), F.col("patch"))).drop("_anchors")
    response = assembled(final.drop("text", "rank"))
    out = response.where("place IS NOT NULL").select("query_id", "item_id", "place", "content", "score")
    return out if pending is None else with_pending(response, pending, shown)


def with_pending(response: DataFrame, pending: DataFrame, slots: int) -> DataFrame:
    """response: query_id, item_id, place, content, score; pending: query_id, item_id, content, ratio of sessions without cards. Seats that
    the cards left free go to pending sessions by overlap; one without any only where a query has no card at all."""
    seats = response.where("place IS NOT NULL").groupBy("query_id").agg(F.max("place").cast("int").alias("taken"))
    rows = pending.join(seats, "query_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0))).where((F.col("ratio") > 0) | (F.col("taken") == 0))
    order = selection.Window.partitionBy("query_id").orderBy(F.desc("ratio"), "item_id")
    rows = rows.withColumn("place", F.col("taken") + F.row_number().over(order)).where(F.col("place") <= slots)
    return response.where("place IS NOT NULL").select("query_id", "item_id", "place", "content", "score").unionByName(rows.select("query_id", "item_id", "place", "content", F.col("ratio").alias("score")))
