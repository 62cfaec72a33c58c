"""Operator 3, chat formatting: reply trees.

A forest of messages (tree, id, parent, role, text, score) is walked by iterative self-joins.
In each round every message joins the one that its climb has reached, and so climbs twice as far:
paths of n messages are known after log2(n) rounds, with their lengths and the sums of their
scores. A message without a reply ends a branch. Branches of a tree are ranked by the mean score
of their messages (higher first, then the longer path, then the smaller leaf id). The paths of the
best ``keep`` are enumerated by the same rounds, and each becomes one conversation, formatted turn
by turn.

The joins carry ids and scores only; texts are joined once at the end, for the chosen paths.

``messages`` makes such a forest from ``conversations`` (conv_id, turn, role, text), which has
no parents: turns reply to the last message before them that has another role; so neighbouring
turns of the same role are alternative replies, branches of the tree. A message's score is the
number of different words in it, split at blanks.

Cases: a message whose parent is null or doesn't exist is a root; messages on a cycle have no
root and no conversation; null tree ids or ids are left out; of rows that repeat (tree, id)
the least (parent, role, text, score) counts, a null parent before all others; a null role or text
is empty, a null score 0; texts of any length are kept whole; several roots of a tree
compete like its branches; an empty table gives an empty result. Depth and fan-out are not
bounded. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, written

KEEP = 3


def messages(conversations: DataFrame) -> DataFrame:
    """(tree, id, parent, role, text, score) from (conv_id, turn, role, text)."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("tree"), F.col("turn").cast("long").alias("id"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.where("tree is not null and id is not null").groupBy("tree", "id").agg(F.min(F.struct("role", "text")).alias("m")).select("tree", "id", "m.*")
    turns = Window.partitionBy("tree").orderBy("id")
    last = F.lag("id").over(turns)
    changed = F.lag("role").over(turns) != F.col("role")
    # The parent of a run of one role is the turn just before the run.
    rows = rows.withColumn("before", F.when(changed, last))
    rows = rows.withColumn("parent", F.last("before", ignorenulls=True).over(turns.rowsBetween(Window.unboundedPreceding, 0))).drop("before")
    score = F.size(F.array_distinct(F.filter(F.split("text", " "), lambda w: w != ""))).cast("double")
    return rows.withColumn("score", score)


def climbs(forest: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, leaf, turns, score) of every root-to-leaf path, and (tree, id, up): the message 2 ** k above, for each k."""
    links = forest.select("tree", "id", "parent", F.col("score").alias("total"))
    known = links.select("tree", F.col("id").alias("parent"), F.lit(True).alias("there"))
    links = written(links.join(known, ["tree", "parent"], "left").select("tree", "id", F.when(F.col("there"), F.col("parent")).alias("up"), "total", F.lit(1).alias("turns")), "reply-links")
    largest = links.groupBy("tree").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    leaves = links.join(links.select("tree", F.col("up").alias("id")).where("id is not null"), ["tree", "id"], "left_anti").select("tree", "id")
    now, ups = links, []
    # A climb that hasn't ended after as many steps as its tree has messages is on a cycle.
    for _ in range(largest.bit_length()):
        ups.append(now.where("up is not null").select("tree", "id", "up"))
        if ups[-1].isEmpty():
            break
        further = now.select("tree", F.col("id").alias("up"), F.col("up").alias("then"), F.col("total").alias("more"), F.col("turns").alias("steps"))
        joined = now.join(further, ["tree", "up"], "left")
        now = written(joined.select("tree", "id", F.col("then").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), (F.col("turns") + F.coalesce("steps", F.lit(0))).alias("turns")), "reply-climbs")
    ended = now.where("up is null").join(leaves, ["tree", "id"], "left_semi")
    return ended.select("tree", F.col("id").alias("leaf"), "turns", (F.col("total") / F.col("turns")).alias("score")), ups


def conversations(forest: DataFrame, keep: int = KEEP, opening: str = "<|", closing: str = "|>\n", end: str = "\n") -> DataFrame:
    """(conv_id, rank, leaf, turns, score, chat): the best branches of each tree, formatted."""
    # One row decides on parent, score, role and text of a message alike.
    said = F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    forest = forest.where("tree is not null and id is not null").groupBy("tree", "id").agg(F.min(said).alias("m")).select("tree", "id", "m.*")
    forest = written(forest, "messages")
    paths, ups = climbs(forest)
    best = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("turns"), "leaf")
    steps = paths.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep).withColumn("id", F.col("leaf")).withColumn("at", F.col("turns") - 1)
    for k, up in enumerate(ups):
        # Of each message of a path so far, the one 2 ** k above joins the path.
        both = F.filter(F.array(F.struct("id", "at"), F.struct(F.col("up").alias("id"), (F.col("at") - (1 << k)).alias("at"))), lambda m: m["id"].isNotNull())
        steps = steps.join(up, ["tree", "id"], "left").select("tree", "rank", "leaf", "score", "turns", F.inline(both))
    said = F.concat(F.lit(opening), "role", F.lit(closing), "text", F.lit(end))
    joined = steps.join(forest.select("tree", "id", "role", "text"), ["tree", "id"]).select("tree", "rank", "leaf", "score", "turns", F.struct("at", said.alias("said")).alias("turn"))
    out = joined.groupBy("tree", "rank", "leaf", "score", "turns").agg(F.sort_array(F.collect_list("turn")).alias("all"))
    return out.select(F.col("tree").alias("conv_id"), "rank", "leaf", "turns", "score", F.array_join("all.said", "").alias("chat"))


def query(spark, sf_dir: str) -> DataFrame:
    return conversations(messages(documents(spark, sf_dir, "conversations")))


ORACLE = """
with recursive r as (
  select conv_id as tree, turn as id, m.role as role, m.text as text from (
    select conv_id, turn, min({'role': coalesce(role, ''), 'text': coalesce(text, '')}) as m from conversations
    where conv_id is not null and turn is not null group by all)),
b as (select *, case when lag(role) over (partition by tree order by id) <> role then lag(id) over (partition by tree order by id) end as before from r),
f as (select tree, id, role, text, last_value(before ignore nulls) over (partition by tree order by id rows unbounded preceding) as parent,
             len(list_distinct(list_filter(string_split(text, ' '), lambda w: w <> '')))::double as score from b),
p(tree, leaf, path, total) as (
  select tree, id, [id], score from f where parent is null
  union all
  select p.tree, f.id, list_append(p.path, f.id), p.total + f.score from p join f on f.tree = p.tree and f.parent = p.leaf),
e as (select *, total / len(path) as score from p where not exists (select 1 from f where f.tree = p.tree and f.parent = p.leaf)),
k as (select *, row_number() over (partition by tree order by score desc, len(path) desc, leaf) as rank from e),
s as (select k.tree, k.rank, k.leaf, k.score, len(k.path) as turns, unnest(k.path) as id, unnest(range(len(k.path))) as at from k where rank <= 3)
select s.tree as conv_id, s.rank::int as rank, s.leaf, s.turns::int as turns, s.score,
       string_agg('<|' || f.role || '|>' || chr(10) || f.text || chr(10), '' order by s.at) as chat
from s join f on f.tree = s.tree and f.id = s.id group by all
"""
