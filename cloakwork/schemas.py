"""Schemas and constant relations of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

# Entity types with their lowest admitted score and their precedence.
ENTITY_TYPES = {
    "PERSON": (0.60, 50),
    "EMAIL_ADDRESS": (0.80, 85),
    "PHONE_NUMBER": (0.60, 80),
    "ORGANIZATION": (0.55, 50),
    "PHYSICAL_ADDRESS": (0.70, 70),
    "US_SSN": (0.50, 90),
    "CREDIT_CARD": (0.70, 90),
    "DATE_OF_BIRTH": (0.70, 75),
    "IP_ADDRESS": (0.60, 85),
    "IN_PAN": (0.60, 90),
    "IN_AADHAAR": (0.60, 90),
    "IN_DIN": (0.60, 90),
    "IN_CIN": (0.70, 90),
}
# Types whose normal form is their digits.
DIGIT_TYPES = ("PHONE_NUMBER", "US_SSN", "CREDIT_CARD", "IN_AADHAAR", "IN_DIN")
# Words that name no organisation by themselves.
GENERIC_ORGANIZATIONS = (
    "aadhaar",
    "cin",
    "company",
    "corporation",
    "din",
    "dob",
    "ip",
    "organisation",
    "pan",
    "private limited",
    "limited",
    "ltd",
    "llp",
    "inc",
    "incorporated",
    "plc",
    "ssn",
)

CANDIDATE = "struct<entity_type:string,start:int,end:int,score:double,recognizer:string,context:string,ordinal:int>"
REPLACEMENT = "struct<start:int,end:int,value:string>"

UNITS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("unit_no", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)
ENTITY = T.StructType(
    [
        T.StructField("entity_type", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("occurrence", T.IntegerType()),
    ]
)
ANNOTATIONS = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField(
            "datasets",
            T.MapType(
                T.StringType(),
                T.ArrayType(
                    T.StructType(
                        [
                            T.StructField("id", T.StringType()),
                            T.StructField("source", T.StringType()),
                            T.StructField("text", T.StringType()),
                            T.StructField("entities", T.ArrayType(ENTITY)),
                        ]
                    )
                ),
            ),
        ),
    ]
)
MAPPING = (
    "struct<entity_type:string,original:string,normalized_original:string,replacement:string,occurrences:bigint>"
)
METADATA = (
    "struct<source_sha256:string,output_sha256:string,config_version:string,model_version:string,schema_version:string>"
)
