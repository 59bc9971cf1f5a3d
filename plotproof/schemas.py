"""Fixed table schemas and the ``conform`` operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING, DOUBLE, INT, LONG = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()
BOOLEAN, DATE, TIMESTAMP = T.BooleanType(), T.DateType(), T.TimestampType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# Table and column names of the domain data model.
TABLES: dict[str, T.StructType] = {
    "produtor": _table(
        id=STRING,
        nome=STRING,
        cpf=STRING,
        municipio=STRING,
        uf=STRING,
        cooperativa=STRING,
        slug=STRING,
    ),
    "talhao": _table(
        id=STRING,
        produtor_id=STRING,
        nome=STRING,
        area_ha=DOUBLE,
        geom_wkt=STRING,
        tipo_geom=STRING,
        car_numero=STRING,
        car_situacao=STRING,
    ),
    "documento": _table(
        id=STRING,
        produtor_id=STRING,
        talhao_id=STRING,
        arquivo_origem=STRING,
        arquivo_padronizado=STRING,
        tipo=STRING,
        campos_json=STRING,
        data_emissao=DATE,
        data_validade=DATE,
        hash_sha256=STRING,
        confianca=DOUBLE,
        status=STRING,
        versao=INT,
    ),
    "lote": _table(
        id=STRING,
        codigo=STRING,
        commodity=STRING,
        safra=STRING,
        quantidade_kg=DOUBLE,
        comprador=STRING,
        data_embarque=DATE,
        status=STRING,
    ),
    "lote_talhao": _table(
        lote_id=STRING,
        talhao_id=STRING,
        quantidade_kg=DOUBLE,
    ),
    "checagem": _table(
        id=STRING,
        talhao_id=STRING,
        codigo=STRING,
        perna=STRING,
        resultado=STRING,
        texto=STRING,
        fonte=STRING,
        data_execucao=TIMESTAMP,
        evidencia_json=STRING,
        categoria=STRING,
        severidade=STRING,
        seq=LONG,
    ),
    "aptidao": _table(
        id=STRING,
        produtor_id=STRING,
        camada=INT,
        satisfeita=BOOLEAN,
        via_documento_id=STRING,
        forca=STRING,
        avaliado_em=TIMESTAMP,
    ),
    "excecao": _table(
        id=STRING,
        tipo=STRING,
        talhao_id=STRING,
        documento_id=STRING,
        lotes_afetados=T.ArrayType(STRING),
        descricao=STRING,
        natureza=STRING,
        status=STRING,
        resolvido_por=STRING,
        resolvido_em=TIMESTAMP,
    ),
    "dossie": _table(
        id=STRING,
        lote_id=STRING,
        versao=INT,
        gerado_em=TIMESTAMP,
        status=STRING,
        aprovado_por=STRING,
        hash_sha256=STRING,
        caminho_pdf=STRING,
        caminho_html=STRING,
        diff=STRING,
    ),
    "evento": _table(
        id=STRING,
        timestamp=TIMESTAMP,
        ator=STRING,
        acao=STRING,
        entidade=STRING,
        entidade_id=STRING,
        detalhe=STRING,
    ),
}

# Vocabularies of the exception type and of the event actor.
EXCEPTION_TYPES = ("bloqueio", "lacuna_sanavel", "dispensa_documentada", "nao_sanavel_pelo_produtor")
ACTORS = ("sistema", "humano")


def key_id(*cols: Column | str) -> Column:
    """Deterministic 32-hex identifier; reruns and task retries give the same id.

    A null is marked, so that it is not the same as a part that is missing.
    """
    parts = [F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("\u0000")).cast("string") for c in cols]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project onto the fixed schema: unknown columns dropped, missing ones null."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[table]
        ]
    )


def require_vocabulary(df: DataFrame, column: str, allowed: tuple[str, ...], nullable: bool = True) -> DataFrame:
    """Fail the job when a value lies outside a closed vocabulary."""
    ok = F.col(column).isin(*allowed)
    ok = (F.col(column).isNull() | ok) if nullable else (F.col(column).isNotNull() & ok)
    message = F.concat(F.lit(f"{column} outside vocabulary: "), F.coalesce(F.col(column), F.lit("null")))
    checked = F.when(ok, F.col(column)).otherwise(F.raise_error(message).cast("string"))
    return df.withColumn(column, checked)


def equal_filter(df: DataFrame, **values) -> DataFrame:
    """Conjunction of equality filters; pushed to the scan."""
    if not values:
        return df
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in values.items()]))
