"""Schemas of the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(spec: str) -> list[T.StructField]:
    kinds = {"s": T.StringType(), "b": T.BooleanType(), "i": T.IntegerType(), "l": T.LongType(), "t": T.TimestampType(), "d": T.DateType()}
    return [T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())]


REPORT = T.StructType(_fields("id:s name:s url:s"))
RELATIONSHIP = T.StructType(_fields("role:s this_table:s this_column:s other_table:s other_column:s cardinality:s other_cardinality:s cross_filter:s is_active:b"))

ITEMS = T.StructType(
    _fields(
        "item_id:s lineage_tag:s item_name:s item_type:s service:s description:s workspace_id:s workspace_name:s dataset_id:s dataset_name:s table_name:s "
        "datatype:s column_type:s expression:s compiled_expression:s properties_yaml:s formatstring:s web_url:s is_unused:b connected_reports:i connected_report_pages:i "
        "connected_visuals:i connected_measures:i connected_columns:i connected_tables:i"
    )
    + [T.StructField("connected_reports_json", T.ArrayType(REPORT)), T.StructField("is_related", T.BooleanType()), T.StructField("relationships_json", T.ArrayType(RELATIONSHIP))]
    + _fields("database_name:s schema_name:s alias:s bq_project:s bq_schema:s bq_source_name:s")
    + [T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("meta", T.MapType(T.StringType(), T.StringType()))]
    + _fields("deleted:b deleted_at:t status:s organization_id:l integration_source_id:l item_group_id:l group_id:s")
)
GRAPH = T.StructType(_fields("source_id:s source:s source_type:s target_id:s target:s target_type:s workspace_id:s edge_kind:s lineage_type:s"))
NODES = T.StructType(_fields("node_id:s name:s group:s organization_id:l"))
EDGES = T.StructType(_fields("source:s target:s organization_id:l bridge_reason:s kind:s level:s lineage_type:s"))
USAGE = T.StructType(_fields("month:d workspace_id:s workspace_name:s report_id:s report_name:s user_email:s user_display_name:s platform:s distribution_method:s report_page:s view_count:i organization_id:l integration_source_id:l"))
GROUPS = T.StructType(
    _fields(
        "id:l group_key:s kind:s organization_id:l ownership_department_id:l ownership_person_id:l steward_id:l category_id:l status:s custom_description:s deleted:b deleted_at:t primary_item_id:s"
    )
)
PERSONS = T.StructType(_fields("id:l name:s organization_id:l is_owner:b is_steward:b is_other:b slack_handle:s"))
GOVERNANCE_CSV = T.StructType(_fields("group_pk:s group_id:s kind:s name:s service:s item_type:s status:s owner:s steward:s department:s category:s custom_description:s"))
STATUS_LOG = T.StructType(_fields("group_id:l old_status:s new_status:s changed_at:t changed_by:s"))
TASKS = T.StructType(_fields("id:s group_id:l state:s status:s assignee_id:l created_at:t updated_at:t done_at:t"))
