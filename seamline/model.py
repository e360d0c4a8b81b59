"""Row types shared by the readers and operators."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, B, L, D = T.StringType(), T.BooleanType(), T.LongType(), T.DoubleType()

#: Where a relation was seen. nullable is three-valued text: true, false, unknown, or '' where nobody said.
EVIDENCE = _struct(source=S, origin=S, constraint=S, delete_rule=S, nullable=S)
#: One relation; the columns of a composite key are in order.
RELATION = _struct(constraint=S, child_table=S, child_columns=T.ArrayType(S), parent_schema=S, parent_table=S, delete_rule=S, all_not_null=B, nullable=S, evidences=T.ArrayType(EVIDENCE))
#: A relation as a schema dump holds it, before evidence is stamped.
DUMPED = _struct(constraint=S, child_table=S, child_columns=T.ArrayType(S), parent_schema=S, parent_table=S, delete_rule=S, all_not_null=B)
SCHEMA_DUMP = _struct(schema=S, dialect=S, tables=T.ArrayType(S), fks=T.ArrayType(DUMPED), cross_schema_fks=T.ArrayType(DUMPED))
SUSPECT = _struct(from_table=S, to_table=S, strong=B)

PHYSICAL = "physical"
VIEWS = ("physical", "logical", "combined")
#: NPMI from which a pair counts as observed; edges added to the partition take it too.
OBSERVED_NPMI = 0.3
