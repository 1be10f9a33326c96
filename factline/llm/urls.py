"""URL filters: rules by host and path, and for what no rule decides trust and distrust spread over links of hosts.

Pages that rules allow make their host a trusted seed, pages that rules block a distrusted one, each by the share of its
pages. Trust is a personalised PageRank along the links of hosts (TrustRank), distrust one against them (Anti-TrustRank):
who links to a distrusted host is distrusted. Both are taken relative to the PageRank with every host as a seed, so a
score is the share of a host's rank that comes from seeds, between 0 and 1 (as spam mass, Gyongyi et al., 2006). A host
whose distrust exceeds its trust by BALANCE is blocked.

The graph: host a leads to host b with the number of a's pages that link to b; links inside a host don't count. A host and
the nearest known host above it (blog.x.org and x.org) are of one owner and lead to each other with one link more. A host
that leads nowhere keeps its score, so a host alone has its own share.

Pages are read once for their links, which are counted per pair of hosts before anything is shuffled; afterwards only
pairs of hosts move. The moves of a host with very many partners are cut into chunks of CHUNK, each of which meets a copy
of the host's score, so a directory's links are not one group. Scores are written every CUT steps, in the shared folder.

Edge cases: a null url, and one without "://", has an empty host and path, no rule and no graph, and is allowed; links
without a host stay on their page's host; null html has no links; a null page_id is kept; repeated rows count as pages of
their own; further columns are ignored by `judge`; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.llm.text import ascii_lower
from factline.session import durable, forget


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, for paths that begin with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
DAMPING, STEPS, BALANCE = 0.85, 12, 0.3
CHUNK = 10_000  # moves of one host that meet one copy of its score
CUT = 4
#: The host of a link's target: absolute, or relative to the scheme.
LINK = r"""(?i)href[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?[\x20\x09-\x0D]*(?:https?:)?//([^/?#"'\x20\x09-\x0D>]+)"""
LONGEST = 253  # characters of a host's name; longer ones are of no family


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The place in `rules` of the longest rule that fits; null for none. The rules are a list of the caller's, so they
    are tried one after another."""
    out = F.lit(None).cast("int")
    for i in sorted(range(len(rules)), key=lambda i: (len(rules[i].text), rules[i].text)):
        r = rules[i]
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(i)).otherwise(out)
    return out


def _of_rule(at: Column, values: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, values)), at) if values else F.lit(None).cast("string")


def judged_by_rules(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, html, host, path, rule, ruled (the rule's verdict)."""
    df = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    df = df.withColumn("at", fitting(F.col("host"), F.col("path"), rules))
    return df.select("page_id", "html", "host", "path", _of_rule(F.col("at"), [r.text for r in rules]).alias("rule"), _of_rule(F.col("at"), [r.verdict for r in rules]).alias("ruled"))


def host_links(judged: DataFrame) -> DataFrame:
    """(source, target, n, pages, trusted, distrusted): pages of source that link to target; a row with source = target
    per host with pages has their number and how many of them rules allow and block."""
    own = F.array(F.col("host"))
    targets = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), ascii_lower)
    each = judged.where("host <> ''").select("host", "ruled", F.explode(F.array_union(own, targets)).alias("target"))
    here = F.col("host") == F.col("target")
    counted = lambda c: F.count_if(here & c)
    return each.groupBy(F.col("host").alias("source"), "target").agg(
        F.count("*").alias("n"), counted(F.lit(True)).alias("pages"), counted(F.col("ruled") == "allow").alias("trusted"), counted(F.col("ruled") == "block").alias("distrusted")
    )


def with_families(links: DataFrame) -> DataFrame:
    """(source, target, n): links, with one more between a host and the nearest known host above it, both ways."""
    known = durable(links.select(F.col("source").alias("host")).union(links.select("target")).distinct(), "known-hosts")
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    child = known.where((F.size(labels) > 1) & (F.length("host") <= LONGEST)).select("host", F.posexplode(above).alias("far", "parent"))
    nearest = child.join(known.select(F.col("host").alias("parent")), "parent").groupBy("host").agg(F.min_by("parent", "far").alias("parent"))
    family = nearest.select(F.col("host").alias("source"), F.col("parent").alias("target"), F.lit(1).alias("n")).union(nearest.select("parent", "host", F.lit(1)))
    return links.select("source", "target", "n").union(family).groupBy("source", "target").agg(F.sum("n").alias("n"))


def moves(edges: DataFrame) -> DataFrame:
    """(kind, node, chunk, to, share, chunks): what part of a node's score moves where in a step: trust along the links,
    distrust against them. A host without moves of a kind keeps its score. Totals are written before they meet the edges,
    so that adaptive execution can split the edges of a hub."""
    others = edges.where("source <> target")
    both = others.select(F.lit("trust").alias("kind"), F.col("source").alias("node"), F.col("target").alias("to"), "n")
    both = both.union(others.select(F.lit("distrust"), "target", "source", "n"))
    totals = durable(both.groupBy("kind", "node").agg(F.sum("n").alias("total"), F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "host-totals")
    hosts = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    kept = hosts.select(F.explode(F.array(F.lit("trust"), F.lit("distrust"))).alias("kind"), "node").join(totals, ["kind", "node"], "left_anti")
    kept = kept.select("kind", "node", F.lit(0).alias("chunk"), F.col("node").alias("to"), F.lit(1.0).alias("share"), F.lit(1).alias("chunks"))
    parted = both.join(totals, ["kind", "node"]).select("kind", "node", F.pmod(F.xxhash64("to"), F.col("chunks")).cast("int").alias("chunk"), "to", (F.col("n") / F.col("total")).alias("share"), "chunks")
    return parted.unionByName(kept)


def host_scores(links: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust), relative, of all hosts with pages or links, after `steps` steps; links: host_links(), written."""
    edges = durable(with_families(links), "host-edges")
    move = durable(moves(edges), "host-moves")
    nodes = durable(move.groupBy("kind", "node").agg(F.max("chunks").alias("chunks")), "host-nodes")
    own = links.where("source = target and pages > 0").select("source", F.explode(F.create_map(F.lit("trust"), F.col("trusted") / F.col("pages"), F.lit("distrust"), F.col("distrusted") / F.col("pages"))).alias("kind", "seed"))
    seeds = durable(nodes.join(own.withColumnRenamed("source", "node"), ["kind", "node"], "left").select("kind", "node", "chunks", F.coalesce("seed", F.lit(0.0)).alias("seed")), "host-seeds")
    flow = lambda c: F.sum(F.col("share") * F.col(c)).alias(f"{c}_got")
    moved = lambda own, c: ((1 - damping) * own + damping * F.coalesce(f"{c}_got", F.lit(0.0))).alias(c)
    scores, written = seeds.select("kind", "node", "chunks", F.col("seed").alias("score"), F.lit(1.0).alias("base")), None
    for step in range(1, steps + 1):
        copies = scores.select("kind", "node", "score", "base", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        got = move.drop("chunks").join(copies, ["kind", "node", "chunk"]).groupBy("kind", F.col("to").alias("node")).agg(flow("score"), flow("base"))
        scores = seeds.join(got, ["kind", "node"], "left").select("kind", "node", "chunks", moved(F.col("seed"), "score"), moved(F.lit(1.0), "base"))
        if step % CUT == 0 and step < steps:
            last, written = written, durable(scores, "host-scores")
            scores = written
            if last is not None:
                forget(last)
    part = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score") / F.col("base"))).alias(kind)
    out = durable(scores.groupBy(F.col("node").alias("host")).agg(part("trust"), part("distrust")), "hosts")
    forget(edges, move, nodes, seeds, *([written] if written is not None else []))
    return out


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, steps: int = STEPS, balance: float = BALANCE) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust; the scores of the page's host are null without a host."""
    judged = judged_by_rules(pages, rules)
    links = durable(host_links(judged), "host-links")
    scores = host_scores(links, steps)
    forget(links)
    df = judged.drop("html").join(scores, "host", "left")
    by_graph = F.when(F.round(F.col("distrust") - F.col("trust"), 9) > balance, "block").otherwise("allow")
    return df.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_graph).alias("verdict"), "trust", "distrust")
