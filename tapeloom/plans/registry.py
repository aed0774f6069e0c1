"""Every query of the market operators, by name, with its SQL."""

from importlib import import_module

FLAGSHIP = "bars_rolling_z"
MODULES = ("bars", "flow", "book", "profile", "structure", "positions", "outcomes", "ledger", "validation", "sequential", "streaming", "other", "studies", "machines", "sessions", "records", "reads", "levels", "columns", "stores", "live", "scans", "stance", "decisions", "pacing", "grid", "contest", "candles", "entries", "controls")


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f".{m}", __package__).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f".{m}", __package__).ORACLE.items()}
