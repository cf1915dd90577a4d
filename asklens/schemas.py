"""Fixed schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


STRING, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()
DOUBLE, BOOL = T.DoubleType(), T.BooleanType()

CATALOG = _struct(
    db_id=STRING, table_idx=INT, table_name=STRING, col_idx=INT,
    col_name=STRING, col_type=STRING, col_desc=STRING,
)

# Spider form; the pairs [table_idx, name] are read as text pairs.
SPIDER_SCHEMA_FILE = _struct(
    db_id=STRING, table_names_original=T.ArrayType(STRING),
    column_names_original=T.ArrayType(T.ArrayType(STRING)),
    column_types=T.ArrayType(STRING), column_descriptions=T.ArrayType(STRING),
)

SELECTION = _struct(selected_sql=STRING, confidence=DOUBLE, candidates_count=INT)
ALTERNATIVE = _struct(sql=STRING, all_sqls_in_group=T.ArrayType(STRING))
METRICS = _struct(generated=INT, execution_errors=INT, valid_generations=INT, unique_valid_sqls=INT)

RECORD = _struct(
    question_id=LONG, question=STRING, db_id=STRING, difficulty=STRING, evidence=STRING,
    gold_sql=STRING, round_1_sql=STRING, round_2_sql=STRING, generated_sql=STRING, winner_sql=STRING,
    execution_match=BOOL, is_correct=BOOL, valid=BOOL, final_valid=BOOL,
    validation_error=STRING, execution_error=STRING,
    winner_confidence=DOUBLE, confidence=DOUBLE,
    execution_time=DOUBLE, execution_times=T.ArrayType(DOUBLE),
    selection=SELECTION, high_confidence_alternatives=T.ArrayType(ALTERNATIVE), metrics=METRICS,
)

LINKING = _struct(
    tables=T.ArrayType(STRING), columns=T.MapType(STRING, T.ArrayType(STRING)),
    joins=T.ArrayType(STRING), join_relationships=T.ArrayType(STRING),
    filters=T.ArrayType(STRING), filters_constraints=T.ArrayType(STRING),
    intent=STRING, question_intent=STRING, raw_output=STRING,
)
LINKING_RECORD = _struct(
    question_id=STRING, db_id=STRING, question=STRING, schema_text=STRING, schema_linking=LINKING)
LINKING_FILE = _struct(by_question_id=T.MapType(STRING, LINKING_RECORD))

PAIR = _struct(input=STRING, output=STRING, db_id=STRING)
