"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame operations only).

1. Targets. Each source weighs as the cycle of weights says; its target is its share of all words,
   at most max_epochs times its own words, the excess reshared by weight (water filling).
2. Quotas. The mix is ceil(words / block_words) equal blocks. Sources get blocks by highest
   quotients target / (2k + 1). Rounding target / divisor gives all seats but a few; the few are
   decided by ranking the next quotients.
3. Shards. A source's documents are dealt into cells by a seeded hash, and cells into shards of about
   shard_words words, so a source with a third of all rows is many shards. There are as many cells as shards would be of all
   words, 4,096 at least, so shards keep their size however large a source is. Rows of documents are joined and ranked by source
   and cell or shard; only tables of sources and of shards have the source as a key, and only the table of sources (a thin row
   each, some hundred bytes) is ranked as a whole. Its quota is split over the shards in whole blocks.
4. Selection. In a shard, documents follow each other in seeded order and are cut into blocks. Each
   block is taken quota div blocks times; the rest of the quota is a cyclic run of blocks that begins
   at a seeded place. What a document gives is then interval arithmetic: no row is made for a block.

Texts are read once, for their words and a hash: that thin table is written to the shared folder, and what the mix needs besides
comes from it; texts are read again only if the result is to hold them.

Nulls: a null text has no words; a null source is a source (last in order); a null id is an id like any
other. Empty texts get nothing. Equal rows are each their own document; rows of one id and size are in the order of their texts'
hashes. An empty table gives an empty result. Input columns named like a result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonoframe.llm.staging import apart, free, staged

#: a source's documents are dealt into so many cells at least, a shard is one cell or several
CELLS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def _hex(text: Column, first: int) -> Column:
    """Eight hex digits of text's MD5 as a number."""
    return F.conv(F.substring(F.md5(text), first, 8), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """sources (_k key, _source, _s words) with weight _w and target _t: one row a source, so a small table."""
    whole, turn = W.partitionBy(), F.array(*[F.lit(w) for w in weights])
    ranked = sources.withColumn("_rn", F.row_number().over(W.orderBy(F.col("_source").isNull(), "_source")))
    ranked = ranked.withColumn("_w", F.element_at(turn, (F.col("_rn") - 1) % len(weights) + 1)).withColumn("_all", F.sum("_s").over(whole)).withColumn("_cap", F.col("_s") * max_epochs)
    by_cap = W.orderBy(F.col("_cap") / F.col("_w"), "_rn")
    ranked = (
        ranked.withColumn("_i", F.row_number().over(by_cap))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_rest", F.sum("_w").over(by_cap.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_level", (F.col("_all") - F.col("_before")).cast("double") / F.col("_rest"))
        .withColumn("_first", F.min(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_i"))).over(whole))
        .withColumn("_level", F.max(F.when(F.col("_i") == F.col("_first"), F.col("_level"))).over(whole))
    )
    return ranked.withColumn("_t", F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w"))).select("_k", "_rn", "_s", "_all", "_t")


def sainte_lague(targets: DataFrame, block_words: int) -> DataFrame:
    """targets with _q, the blocks that each source gets of all ceil(words / block_words)."""
    whole = W.partitionBy()
    start = (
        targets.withColumn("_n", F.ceil(F.col("_all") / block_words))
        .withColumn("_q0", F.when(F.col("_all") > 0, F.floor(F.col("_t") / (F.col("_all") / F.col("_n")) + 0.5)).otherwise(0).cast("long"))
        .withColumn("_d", F.col("_n") - F.sum("_q0").over(whole))
    )
    # the seat after the last (or the last itself, to give back), and so on: as many as the source could need. The divisor that gives all
    # seats moves the sum of t / divisor by no more than |d| and the number of sources, a source's part of that is its share of t
    most = F.least(F.abs("_d"), (F.floor(F.coalesce(F.try_divide(F.col("_t"), F.col("_all")), F.lit(0.0)) * (F.abs("_d") + F.count("*").over(whole))) + 2).cast("long"))
    start = start.withColumn("_most", most)
    step = F.explode(F.when(F.col("_d") != 0, F.sequence(F.lit(0), F.col("_most") - 1)).otherwise(F.array()))
    seats = start.filter("_d <> 0").select("_k", "_rn", "_t", "_q0", "_d", step.alias("_j")).withColumn("_seat", F.when(F.col("_d") > 0, F.col("_q0") + F.col("_j")).otherwise(F.col("_q0") - 1 - F.col("_j")))
    seats = seats.filter("_seat >= 0").withColumn("_quotient", F.col("_t") / (2 * F.col("_seat") + 1))
    order = W.orderBy(F.when(F.col("_d") > 0, -F.col("_quotient")).otherwise(F.col("_quotient")), "_rn", "_j")
    moved = seats.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= F.abs("_d")).groupBy("_k").agg(F.sum(F.signum("_d").cast("long")).alias("_more"))
    return start.join(moved, "_k", "left").withColumn("_q", F.col("_q0") + F.coalesce("_more", F.lit(0)))


#: columns of measured()
MEASURES = ("_n_words", "_text_hash")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with what the mix needs of a text: its number of words and a hash. Then it takes no text."""
    return docs.withColumns({MEASURES[0]: F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0)), MEASURES[1]: F.md5(F.coalesce(F.col(text_col), F.lit("")))})


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, block_words: int = 16, shard_words: int = 1 << 20, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", measures: bool = False) -> DataFrame:
    """docs with size, source_size, target and taken (words that the mix takes of the document).

    With measures docs is a table of measured(), written beforehand; its measures are left out of the result.
    The tables of sources and of shards are joined without a hint: Spark broadcasts them only below
    spark.sql.autoBroadcastJoinThreshold, and splits skewed keys of a sort-merge join otherwise.
    """
    used = [id_col, source_col, *(MEASURES if measures else [text_col])]
    found = apart(docs, used, ["size", "source_size", "target", "taken"], lambda own: _mixed(own, weights, max_epochs, block_words, shard_words, seed, id_col, text_col, source_col, measures))
    return found.drop(*MEASURES) if measures else found


def _mixed(docs: DataFrame, weights: tuple[int, ...], max_epochs: int, block_words: int, shard_words: int, seed: int, id_col: str, text_col: str, source_col: str, measures: bool) -> DataFrame:
    block = F.lit(block_words)
    own = docs if measures else measured(docs, text_col)
    base = own.withColumns({
        "_k": F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")), "_size": F.col(MEASURES[0]), "_tie": F.col(MEASURES[1]),
        "_key": F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))),
    })
    base = base.withColumn("_h", F.md5("_key"))
    thin = base.select("_k", F.col(source_col).alias("_source"), "_size", _hex(F.col("_h"), 9).alias("_place"))
    thin = thin if own is docs else staged(thin, "mix-sizes")
    words = thin.agg(F.sum("_size")).first()[0] or 0
    n_cells = max(CELLS, 1 << (max(1, -(-words // shard_words)) - 1).bit_length())
    base = base.withColumn("_cell", F.pmod(_hex(F.col("_h"), 9), F.lit(n_cells)))
    thin = thin.withColumn("_cell", F.pmod("_place", F.lit(n_cells)))
    cells = thin.groupBy("_k", "_cell").agg(F.max("_source").alias("_source"), F.sum("_size").alias("_words"))
    sources = cells.groupBy("_k").agg(F.max("_source").alias("_source"), F.sum("_words").alias("_s"))
    targets = source_targets(sources, weights, max_epochs)
    cells = cells.join(targets.select("_k", "_s", "_t"), "_k").withColumn("_sub", F.pmod(F.col("_cell"), F.greatest(F.lit(1), F.ceil(F.col("_s") / shard_words))))
    shards = cells.groupBy("_k", "_sub").agg(F.sum("_words").alias("_words")).withColumn("_nb", F.ceil(F.col("_words") / block).cast("long"))
    up_to = W.partitionBy("_k").orderBy("_sub")
    quotas = (
        shards.withColumns({"_cum": F.sum("_nb").over(up_to.rowsBetween(W.unboundedPreceding, 0)), "_all_nb": F.sum("_nb").over(W.partitionBy("_k"))})
        .join(sainte_lague(targets, block_words).select("_k", "_q"), "_k")
        .withColumn("_q", F.least("_q", F.col("_all_nb") * max_epochs))
        .withColumn("_qj", F.expr("if(_nb = 0, 0L, (cast(_q as decimal(19,0)) * cast(_cum as decimal(19,0))) div _all_nb - (cast(_q as decimal(19,0)) * cast(_cum - _nb as decimal(19,0))) div _all_nb)"))
        .withColumns({"_e": F.expr("if(_nb = 0, 0L, _qj div _nb)"), "_r": F.expr("if(_nb = 0, 0L, _qj % _nb)")})
        .withColumn("_at", F.when(F.col("_nb") > 0, _hex(F.concat_ws(":", F.lit(str(seed)), F.col("_k"), F.col("_sub").cast("string")), 1) % F.col("_nb")).otherwise(0))
        .select("_k", "_sub", "_nb", "_e", "_r", "_at")
    )
    in_order = W.partitionBy("_k", "_sub").orderBy("_h", "_key", "_size", "_tie").rowsBetween(W.unboundedPreceding, 0)
    cells = cells.select("_k", "_cell", "_s", "_t", "_sub").join(quotas, ["_k", "_sub"])
    laid = base.join(cells, ["_k", "_cell"]).withColumn("_to", F.sum("_size").over(in_order))
    begin = F.col("_to") - F.col("_size")
    overlap = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col("_to"), hi * block) - F.greatest(begin, lo * block))
    stop = F.col("_at") + F.col("_r")
    extra = overlap(F.col("_at"), stop) + F.when(stop > F.col("_nb"), overlap(F.lit(0), stop - F.col("_nb"))).otherwise(0)
    results = {"size": F.col("_size"), "source_size": F.col("_s"), "target": F.col("_t"), "taken": (F.col("_e") * F.col("_size") + extra).cast("long")}
    kept = [c for c in docs.columns if c.lower() not in results]
    return laid.select(*[F.col(f"`{c}`") for c in kept], *[v.alias(k) for k, v in results.items()])


def materialise(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as its taken words make it up, to the nearest whole copy."""
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    return mixed.filter(copies > 0).select(*columns, F.explode(F.sequence(F.lit(1), copies)).alias(free(columns, "copy"))).select(*columns)
