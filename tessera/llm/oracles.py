"""DuckDB SQL for those text queries that SQL can express."""


from tessera.llm import chat_format, embedding_dedup, line_dedup, near_dedup


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": chat_format.SQL,
        "op5_line_dedup": line_dedup.SQL,
        "op6_near_dedup": near_dedup.SQL,
        "op9_embedding_dedup": embedding_dedup.SQL,
    }
