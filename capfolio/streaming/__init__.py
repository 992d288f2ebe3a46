"""Intentionally empty: the system being matched has no stream source, watermark
or stateful operator, so none is offered here. Refresh is a batch rebuild
published as a new snapshot (``capfolio.sinks.snapshot``).
"""
