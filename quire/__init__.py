"""quire: a Spark-first analytics engine for bundles of Markdown documents."""

from importlib import import_module

#: Where each public name lives; modules are imported when a name is first used.
_PUBLIC = {
    "Bundle": "operators.bundle",
    "load_bundle": "operators.bundle",
    "validate_path": "operators.bundle",
    "ReadAdapter": "operators.graphql",
    "TypedRelations": "operators.typed",
    "contracts": "plans.contract",
    "render_graphql": "plans.contract",
    "render_json_schema": "plans.contract",
    "render_pydantic": "plans.contract",
    "render_zod": "plans.contract",
    "apply_sql": "operators.apply",
    "edit_body": "operators.apply",
    "replace_values": "operators.apply",
    "scaffold": "operators.apply",
    "import_rows": "operators.imports",
    "format_bundle": "functions.formatting",
}
__all__ = sorted(_PUBLIC)


def __getattr__(name: str):
    if name not in _PUBLIC:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_PUBLIC[name]}"), name)
