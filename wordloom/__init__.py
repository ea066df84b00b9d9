"""wordloom: text-entity analytics as Spark DataFrame transforms.

Packages:
  functions  Column -> Column scalar expressions (cleaning, tokens, shapes)
  operators  DataFrame -> DataFrame transforms (features, labels, vectors, clusters)
  sources    readers and writers (XML, TSV, CSV, Parquet, text)
  plans      stage runner and the registered queries over the driver tables
  streaming  the per-row stages under readStream
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Serialise this package's functions by value inside UDFs.

    Python workers then need no installed copy of the package: the code of
    every UDF helper travels with the task, on a cluster as in local mode.
    """
    import sys
    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover - pyspark always ships it
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
