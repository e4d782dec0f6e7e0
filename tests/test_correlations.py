"""The six rules on values worked out by hand."""

from sparkloom.operators import correlations as C


def outputs(spark, **change):
    rows = {
        "efficiency": ([("p", 35, "declining")], "project string, aes int, trend string"),
        "comprehension": ([("p", "auth", 25, True), ("p", "api", 80, False), ("p", "ui", 45, False)], "project string, domain string, score int, blind boolean"),
        "cost": ([("p", 0.45, 12.0)], "project string, waste_ratio double, total double"),
        "cost_domains": ([("p", "ui", 40, 1), ("p", "API-server", 30, 2)], "project string, domain string, percentage int, place int"),
        "loops": ([("p", "db", 2), ("p", "auth", 1)], "project string, domain string, place int"),
        "velocity": ([("p", "ui", "decelerating"), ("p", "auth", "stable"), ("p", "none", "decelerating")], "project string, domain string, trend string"),
        "patterns": ([("p", "api", 1)], "project string, domain string, place int"),
        "alerts": ([("p", "auth", "warning", 1), ("p", "ui", "warning", 2), ("p", "auth", "info", 3)], "project string, domain string, severity string, place int"),
    }
    return {n: spark.createDataFrame(change.get(n, r), s) for n, (r, s) in rows.items() if change.get(n, r) is not None}


def held(df):
    return {r.rule: (r.severity, r.domain, r.domains) for r in df.collect()}


def test_rules(spark):
    assert held(C.correlations(outputs(spark))) == {
        "efficiency-blind-spot": ("critical", "auth", ["auth"]), "cost-loop": ("critical", "auth", ["auth", "db"]), "velocity-comprehension": ("info", "ui", ["ui"]),
        "expertise-cost": ("warning", "API-server", ["API-server"]), "blind-spot-acceptance": ("critical", "auth", ["auth"]),
    }
    other = outputs(spark, efficiency=[("p", 60, "improving")], cost=[("p", 0.2, 0.0)], velocity=[("p", "auth", "decelerating"), ("p", "ui", "decelerating")])
    assert held(C.correlations(other)) == {
        "cost-loop": ("warning", "auth", ["auth", "db"]), "velocity-comprehension": ("warning", "auth", ["auth", "ui"]), "pattern-efficiency": ("info", "api", ["api"]), "blind-spot-acceptance": ("critical", "auth", ["auth"]),
    }


def test_missing_outputs(spark):
    assert set(held(C.correlations(outputs(spark, comprehension=None)))) == {"cost-loop"}
    assert C.correlations({}) is None and C.correlations({"efficiency": outputs(spark)["efficiency"]}) is None
    assert held(C.correlations(outputs(spark, cost=[("p", None, None)], efficiency=[("q", 10, "declining")], alerts=[]))) == {"velocity-comprehension": ("info", "ui", ["ui"])}
