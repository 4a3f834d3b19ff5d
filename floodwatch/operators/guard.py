"""Controller load tiers and the protocol-drop switch they drive."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodwatch.operators.features import CLASS_PROTOCOL
from floodwatch.plans.slices import sorted_map

# Cpu and memory bounds per tier, memory ceiling, throttle delays.
TIERS = (("CRIT", 99.0, 95.0), ("HIGH", 95.0, 85.0), ("WARN", 85.0, 70.0))
MEMORY_CEILING_MB = 150.0
CRIT_DELAY, HIGH_DELAY, HIGH_STREAK = 0.05, 0.02, 2


def memory_percent(mem_mb: Column) -> Column:
    return F.least(mem_mb / MEMORY_CEILING_MB * 100.0, F.lit(100.0))


def resource_tier(cpu: Column, mem_pct: Column) -> Column:
    tier = None
    for name, c, m in TIERS:
        hit = (cpu >= c) | (mem_pct >= m)
        tier = F.when(hit, name) if tier is None else tier.when(hit, name)
    return tier.otherwise("NORMAL")


def guard_transitions(readings: DataFrame, key: str = "controller") -> DataFrame:
    """Throttle delay and protocol-drop commands after each reading of a controller.

    ``readings``: controller, ts, id, tier, attack_class (last confirmed class or
    null). A streamed fold per controller; state is five scalars.
    """
    schema = T.StructType([*readings.select(key, "ts", "id", "tier").schema.fields,
                           T.StructField("consecutive", T.LongType()), T.StructField("throttle_s", T.DoubleType()),
                           T.StructField("rules_active", T.BooleanType()),
                           T.StructField("installed_proto", T.LongType()), T.StructField("command", T.StringType())])
    numbers = dict(CLASS_PROTOCOL)

    def fold(batches):
        who, streak, delay, wanted, installed = None, 0, 0.0, None, None
        for batch in batches:
            rows = []
            for k, tier, klass in zip(batch[key], batch["tier"], batch["attack_class"]):
                if k != who:
                    who, streak, delay, wanted, installed = k, 0, 0.0, None, None
                wanted = numbers.get(klass, wanted)
                said = []
                if tier == "CRIT":
                    streak, delay = streak + 1, CRIT_DELAY
                    if wanted != installed:
                        if installed is not None:
                            said.append(f"remove {installed}")
                        installed = wanted
                        said.append(f"install {wanted}")
                elif tier == "HIGH" and installed is None:
                    streak += 1
                    delay = HIGH_DELAY if streak >= HIGH_STREAK else delay
                else:
                    streak, delay = 0, HIGH_DELAY if tier == "HIGH" else 0.0
                    if installed is not None:
                        said.append(f"remove {installed}")
                        installed = None
                rows.append((streak, delay, installed is not None, installed, "; ".join(said) or None))
            out = batch[[key, "ts", "id", "tier"]].reset_index(drop=True)
            made = pd.DataFrame(rows, columns=["consecutive", "throttle_s", "rules_active", "installed_proto", "command"])
            made["installed_proto"] = made["installed_proto"].astype("Int64")
            yield pd.concat([out, made], axis=1)

    return sorted_map(readings.select(key, "ts", "id", "tier", "attack_class"), [key], ["ts", "id"], fold, schema)
