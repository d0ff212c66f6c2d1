"""Small invented data sets: a fixed one for tests, and one that scales by a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import DOCUMENTS, ENTITIES, RELATIONSHIPS, RULES


def small(spark: SparkSession) -> dict[str, DataFrame]:
    """Twelve entities, thirteen edges, four documents and four rules."""
    names = {
        "Service": ["orders-svc", "ledger-svc", "mail-svc"],
        "Component": ["orders-db", "ledger-queue", "mail-cache"],
        "Team": ["orders-team", "ledger-team", "mail-team"],
        "Person": ["Ada Moss", "Lin Park", "Sam Reed"],
    }
    entities = [(f"{kind}-{i}", kind, name, {"rank": str(i)}) for kind, group in names.items() for i, name in enumerate(group)]
    links = [(f"Team-{i}", f"Service-{i}", "OWNS") for i in range(3)]
    links += [(f"Service-{i}", f"Component-{i}", "DEPENDS_ON") for i in range(3)]
    links += [(f"Person-{i}", f"Team-{i}", "MEMBER_OF") for i in range(3)]
    links += [("Service-0", "Service-1", "CALLS"), ("Service-0", "Service-2", "CALLS"), ("Service-1", "Service-2", "CALLS"), ("Team-0", "Service-1", "SUPPORTS")]
    edges = [(f"edge-{i}", a, b, kind, {}) for i, (a, b, kind) in enumerate(links)]
    documents = [
        (f"doc-{i}", "runbook", f"Runbook {name}", f"{name} is owned by {team}.\n\nRestart {name} first. Then call the team.", {})
        for i, (name, team) in enumerate(zip(names["Service"], names["Team"]))
    ] + [("doc-3", "incident", "Incident 1", "ledger-svc was down. The cause was ledger-queue.", {})]
    texts = ["Every service must have an owner", "Critical paths need a circuit breaker", "An escalation path is required", "Runbooks are current"]
    rules = [(f"rule-{i}", f"rule_{i}", "validation", (text,), text, 10 - i, ["Service"]) for i, text in enumerate(texts)]
    return {
        "entities": spark.createDataFrame(entities, ENTITIES),
        "relationships": spark.createDataFrame(edges, RELATIONSHIPS),
        "documents": spark.createDataFrame(documents, DOCUMENTS),
        "rules": spark.createDataFrame(rules, RULES),
    }


def scaled(spark: SparkSession, services: int = 50, people: int = 150, incidents: int = 60) -> dict[str, DataFrame]:
    """Services in deploy groups, teams, people and chains of incidents, by number alone."""
    teams = max(services // 5, 1)
    ids = {"Service": services, "Team": teams, "Person": people, "Incident": incidents}
    entities = None
    for kind, n in ids.items():
        part = spark.range(n).select(
            F.concat(F.lit(f"{kind}-"), "id").alias("id"), F.lit(kind).alias("type"), F.concat(F.lit(f"{kind.lower()}-"), "id").alias("name"), F.create_map(F.lit("rank"), F.col("id").cast("string")).alias("properties")
        )
        entities = part if entities is None else entities.unionByName(part)

    def edge(df: DataFrame, source: str, target: str, kind: str) -> DataFrame:
        return df.select(F.concat_ws(">", source, F.lit(kind), target).alias("id"), F.col(source).alias("source_id"), F.col(target).alias("target_id"), F.lit(kind).alias("type"), F.create_map().cast("map<string,string>").alias("properties"))

    def numbered(n: int, a: str, b: str, to, least: int = 0) -> DataFrame:
        return spark.range(least, n).select(F.concat(F.lit(a), "id").alias("a"), F.concat(F.lit(b), to(F.col("id")).cast("string")).alias("b"))

    owns = edge(numbered(services, "Service-", "Team-", lambda i: i % teams), "b", "a", "OWNS")
    members = edge(numbered(people, "Person-", "Team-", lambda i: F.pmod(F.xxhash64(i), F.lit(teams))), "a", "b", "MEMBER_OF")
    chains = edge(numbered(incidents, "Incident-", "Incident-", lambda i: i - 1, 1), "a", "b", "CAUSED_BY")
    group = spark.range(services).select(F.floor(F.col("id") / 5).alias("g"), F.col("id"))
    pairs = group.alias("x").join(group.alias("y"), (F.col("x.g") == F.col("y.g")) & (F.col("x.id") < F.col("y.id")))
    pairs = pairs.select(F.concat(F.lit("Service-"), F.col("x.id")).alias("a"), F.concat(F.lit("Service-"), F.col("y.id")).alias("b"))
    edges = owns.unionByName(members).unionByName(chains).unionByName(edge(pairs, "a", "b", "DEPLOYS_WITH"))
    documents = spark.range(services).select(
        F.concat(F.lit("doc-"), "id").alias("id"), F.lit("runbook").alias("type"), F.concat(F.lit("Runbook service-"), "id").alias("title"),
        F.concat(F.lit("To restart service-"), "id", F.lit(" follow these steps. Then tell its team.")).alias("content"), F.create_map().cast("map<string,string>").alias("metadata"),
    )
    return {"entities": entities, "relationships": edges, "documents": documents, "rules": small(spark)["rules"]}
