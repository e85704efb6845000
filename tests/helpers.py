"""Plain-Python definitions and small record tables for the tests."""

import random

RECORD = "entity_id string, business_name string, business_address string, country string, src int, rowno long"


def records(spark, rows, src=0):
    """rows: (id, name, address, country)."""
    return spark.createDataFrame([(*r, src, i) for i, r in enumerate(rows)], RECORD)


def random_records(seed, n, src):
    rng = random.Random(seed)
    names = "blue moon cafe golden dragon kitchen acme widgets star sun river stone old new house".split()
    streets = "main oak lake hill park mill church river".split()
    rows = []
    for i in range(n):
        name = " ".join(rng.sample(names, rng.randrange(1, 4)))
        if rng.random() < 0.2:
            name = name[:-1] + rng.choice("aeiou")
        address = f"{rng.randrange(1, 30)} {rng.choice(streets)} St, {rng.choice(['Austin', 'Delhi', 'Paris'])} {rng.choice([78701, 78702, 110001])}"
        rows.append((f"S{src + 1}-{i}", name, rng.choice([address, address, address, None, ""]), rng.choice(["US", "US", "IN", None])))
    return rows


def values(spark, rows, expression, types="string"):
    """Results of a column function on rows of strings, in order."""
    columns = [f"c{k}" for k in range(len(rows[0]))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} {types}" for c in columns))
    return [r.v for r in df.select("i", expression(*(df[c] for c in columns)).alias("v")).orderBy("i").collect()]
