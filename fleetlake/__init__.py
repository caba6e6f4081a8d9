"""fleetlake: operational telemetry analytics as Spark DataFrame jobs.

Layers (each a function DataFrame -> DataFrame):
  sources.telemetry / sources.files  -> operators.bronze -> operators.silver
  -> operators.health, operators.incidents -> operators.dashboard, operators.triage
Side tables: operators.runlog (latest-wins logs), operators.profile and
operators.analysis (any dataset). plans.medallion wires the refresh to storage;
streaming.refresh runs it incrementally; plans.catalog names every query.
"""

__version__ = "0.1.0"
