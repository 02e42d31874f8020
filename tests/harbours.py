"""A small graph of the tests: ports, ships and a crane; voyages, berths and ownership."""

from dataclasses import replace

from pathloom.sources.graph import PropertyGraph


def harbours(spark):
    """Ports Oslo (10), Porto (11) and Kobe (12, no depth); ships Mira (20) and Selene (21, also a Tug); crane (30)."""
    nodes = [
        (10, ["Port"], "Oslo", 14, None, None),
        (11, ["Port"], "Porto", 9, None, None),
        (12, ["Port"], "Kobe", None, None, None),
        (20, ["Ship"], "Mira", None, 3.5, None),
        (21, ["Ship", "Tug"], "Selene", None, 0.25, None),
        (30, ["Crane"], None, None, None, True),
    ]
    nodes = spark.createDataFrame(nodes, "id long, labels array<string>, name string, depth long, tons double, electric boolean")
    calls = spark.createDataFrame([(100, 20, 10, 4), (101, 20, 11, 7), (102, 21, 11, 1)], "id long, src long, dst long, days long")
    routes = spark.createDataFrame([(200, 10, 11, 2900.5), (201, 11, 12, 21000.0), (202, 12, 12, 0.0)], "id long, src long, dst long, miles double")
    serves = spark.createDataFrame([(300, 30, 10)], "id long, src long, dst long")
    graph = PropertyGraph(spark).with_entities(nodes, [("CALLS", calls), ("ROUTE", routes), ("SERVES", serves)])
    return replace(graph, next_node=40, next_rel=400)
