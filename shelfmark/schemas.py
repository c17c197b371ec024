"""Fixed schemas; nothing is inferred from data."""

from pyspark.sql import types as T

_s, _l, _b, _i = T.StringType(), T.LongType(), T.BooleanType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MANIFEST = _struct(path=_s, name=_s, size=_l, modified=_l, etag=_s)
#: A manifest snapshot: partitioned by the first path element.
SNAPSHOT = T.StructType([*MANIFEST.fields, T.StructField("root", _s)])
LISTING = _struct(path=_s, name=_s, size=_l, modified=_l, etag=_s, is_dir=_b)
CATALOG_ENTRY = _struct(dir=_s, name=_s, size=_l, modified=T.TimestampType(), is_dir=_b)
_ENTRY = _struct(name=_s, size=_l, is_dir=_b, modified=T.TimestampType(), type=_i)
LIST_RESPONSE = _struct(code=_i, message=_s, data=_struct(content=T.ArrayType(_ENTRY), provider=_s, readme=_s, total=_i, write=_b))
GET_RESPONSE = _struct(code=_i, message=_s, data=_struct(is_dir=_b, modified=T.TimestampType(), name=_s, provider=_s, raw_url=_s, readme=_s, size=_l, type=_i))
