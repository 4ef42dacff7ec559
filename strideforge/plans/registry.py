"""All queries of the sensor jobs, by name."""

from strideforge.plans import frame_queries, long_queries, model_queries

MODULES = [frame_queries, model_queries, long_queries]


def flagship(spark, sf_dir):
    return frame_queries.flagship(spark, sf_dir)


def queries():
    found = {"flagship": flagship}
    for m in MODULES:
        found.update(m.Q)
    return found


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.SQL.items()}
