"""Schemas of the knowledge base: tables, nested JSON payloads, defaults."""

from __future__ import annotations

from pyspark.sql import types as T

L, S, I, B, D, TS, TN = T.LongType(), T.StringType(), T.IntegerType(), T.BooleanType(), T.DoubleType(), T.TimestampType(), T.TimestampNTZType()
VECTOR = T.ArrayType(T.FloatType())


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


AUDIT = {"creator": S, "create_time": TS, "updater": S, "update_time": TS, "deleted": T.ShortType(), "tenant_id": L}
AUDIT_NTZ = AUDIT | {"create_time": TN, "update_time": TN}

TABLES = {
    "user": struct(id=L, email=S, phone=S, nick_name=S, username=S, password=S, role=S, is_active=B, source=S, remark=S, **AUDIT),
    "model": struct(id=L, name=S, model_type=S, model_name=S, provider=S, credential=S, user_id=L, meta=S, status=S, permission_type=S, remark=S, **AUDIT),
    "dataset": struct(id=L, name=S, desc=S, type=S, embedding_mode_id=L, llm_mode_id=L, meta=S, user_id=L, remark=S, **AUDIT),
    "application_dataset_mapping": struct(id=L, application_id=L, dataset_id=L),
    "document": struct(
        id=L, file_id=L, user_id=L, title=S, name=S, type=S, url=S, content=S, char_length=I, status=S, is_active=B, meta=S, dataset_id=L, hit_handling_method=S, directly_return_similarity=D, paragraph_count=I, files=S, **AUDIT_NTZ
    ),
    "paragraph": struct(
        id=L, source_id=L, source_type=S, title=S, content=S, md5=S, status=S, hit_num=I, is_active=B, dataset_id=L, document_id=L, embedding=VECTOR, title_embedding=VECTOR, meta=S, **AUDIT
    ),
    "sentence": struct(id=L, type=I, content=S, md5=S, hit_num=I, dataset_id=L, document_id=L, paragraph_id=L, embedding=VECTOR, meta=S, **AUDIT),
    "problem": struct(id=L, content=S, hit_num=I, dataset_id=L, **AUDIT),
    "problem_paragraph_mapping": struct(id=L, dataset_id=L, document_id=L, paragraph_id=L, problem_id=L, **AUDIT),
    "embedding_cache": struct(id=L, t=S, m=S, v=VECTOR, md5=S),
    "file": struct(id=L, md5=S, filename=S, file_size=L, user_id=L, platform=S, region_name=S, bucket_name=S, file_id=S, target_name=S, tags=S, **AUDIT_NTZ),
    "application_chat_record": struct(
        id=L, vote_status=S, problem_text=S, answer_text=S, message_tokens=I, answer_tokens=I, const=I, details=S, improve_paragraph_id_list=T.ArrayType(L), run_time=D, index=I, chat_id=L, **AUDIT
    ),
    "paragraph_summary_cache": struct(id=L, md5=S, src=S, content=S, elapsed=L, model=S, system_fingerprint=S, completion_tokens=I, prompt_tokens=I, total_tokens=I),
    "web_page_cache": struct(id=L, url=S, text=S, html=S, create_time=TS),
}

NO_REFERENCES = struct(status=S, value=S)
DATASET_SETTING = struct(top_n=I, similarity=T.FloatType(), max_paragraph_char_number=I, search_mode=S, no_references_setting=NO_REFERENCES)
MODEL_SETTING = struct(prompt=S, system=S, no_references_prompt=S)
HIT = struct(id=L, content=S, title=S, dataset_id=L, dataset_name=S, document_id=L, document_name=S, paragraph_id=L, hit_num=I, status=S)
SEARCH_STEP = struct(cost=D, run_time=D, step_type=S, model_name=S, problem_text=S, paragraph_list=T.ArrayType(HIT))
CHAT_STEP = struct(cost=D, model_id=L, run_time=D, step_type=S, message_list=T.ArrayType(struct(role=S, content=S)), answer_tokens=I, message_tokens=I)
RECORD_DETAIL = struct(chat_step=CHAT_STEP, search_step=SEARCH_STEP)

DEFAULT_SIMILARITY, DEFAULT_TOP_N = 0.0, 10
DEFAULT_EMBEDDING_MODEL = "text-embedding-3-large"
SUPERUSER = 1
