"""A Spark-native engine for declarative data pipelines."""

#: Public names and where they are; they are imported when asked for, since Spark's workers import this package, too.
_PLACES = {
    "Engine": "spillway.plans.jobs", "Job": "spillway.plans.spec", "SpecError": "spillway.plans.spec", "parse": "spillway.plans.spec", "job": "spillway.plans.dsl", "compile_job": "spillway.plans.dag",
    "decorate_sinks": "spillway.plugins", "register_function": "spillway.plugins", "register_sink": "spillway.plugins", "register_source": "spillway.plugins", "register_step": "spillway.plugins",
    "register_enricher": "spillway.plugins", "register_translator": "spillway.plugins", "ship": "spillway.shipping",
}
__all__ = list(_PLACES)


def __getattr__(name: str):
    if name in _PLACES:
        from importlib import import_module

        return getattr(import_module(_PLACES[name]), name)
    raise AttributeError(f"module 'spillway' has no attribute '{name}'")
