"""Public-safety and property-risk analytics as Spark jobs.

Layout: ``sources`` (scans, conform specs, sinks), ``functions`` (column expressions), ``operators`` (joins and
aggregations with a scaling story of their own), ``plans`` (the composite questions), ``streaming``.
"""

__version__ = "0.1.0"
