"""Molecules in the pores of a phase."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.operators import placing
from voxlake.plans.catalog import _COVER, BOX, SHAPE, _image, drawn, query
from voxlake.tables import table

RADIUS, SEED, ATTEMPTS = 0.3, 20260, 6


def _u(stream: str, k: int) -> str:
    return f"('0x' || substr(sha256('{SEED}|{stream}-{k}|' || id), 1, 13))::bigint / 4503599627370496.0::double"


def _near(a: str, b: str) -> str:
    dx, dy = (_image(f"{a}.{c} - {b}.{c}", BOX) for c in "xy")
    return f"sqrt({dx} * {dx} + {dy} * {dy} + ({a}.z - {b}.z) * ({a}.z - {b}.z)) <= {2 * RADIUS}"


def _sql() -> str:
    """Rounds written out one after another."""
    steps = [f"{_COVER}, spots as materialized (select row_number() over (order by z, y, x) - 1 r, x, y, z, count(*) over () n from c), kept0 as (select 0::bigint id, 0 attempt, 0.0::double x, 0.0::double y, 0.0::double z where false)"]
    for k in range(ATTEMPTS):
        steps.append(f"""tried{k} as materialized (select id, {k} attempt, s.x + {_u('x', k)} x, s.y + {_u('y', k)} y, s.z + {_u('z', k)} z
  from (select p_partkey id from part where p_partkey not in (select id from kept{k})) m join spots s on s.r = floor({_u('spot', k)} * s.n)),
free{k} as materialized (select * from tried{k} a where not exists (select 1 from kept{k} b where {_near('a', 'b')})),
kept{k + 1} as materialized (select * from kept{k} union all select * from free{k} a where not exists (select 1 from free{k} b where b.id < a.id and {_near('a', 'b')}))""")
    return ",\n".join(steps) + f" select p_partkey id, attempt::int attempt, round(x, 8) x, round(y, 8) y, round(z, 8) z from part left join kept{ATTEMPTS} k on k.id = p_partkey"


@query("placed_molecules", _sql())
def placed_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as molecules in the pores of the supplier phase, in six rounds."""
    molecules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    out = placing.placed(molecules, drawn(spark, sf_dir), SHAPE, RADIUS, SEED, ATTEMPTS)
    return out.select("id", "attempt", *[F.round(c, 8).alias(c) for c in "xyz"])
