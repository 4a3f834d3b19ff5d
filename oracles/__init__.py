"""DuckDB texts the registered queries are checked against."""

from oracles import detect, flows, fusion, ledger, packets

ORACLES: dict[str, str] = {**packets.SQL, **flows.SQL, **fusion.SQL, **ledger.SQL, **detect.SQL}
ORACLES["evaluate_decisions"] = fusion.SQL["score_decisions"]
