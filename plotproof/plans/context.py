"""Everything a verification run reads, in one place."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotproof.catalog import FIELD_ALIASES, Params, default_params
from plotproof.functions.dates import lenient_date
from plotproof.functions.numbers import lenient_number
from plotproof.functions.text import digits, first_filled, fold_name
from plotproof.session import materialise

# Extracted field names the rules read.
FIELD_NAMES = sorted({n for names in FIELD_ALIASES.values() for n in names} | {"talhao_citado"})

#: Columns of the documents that no JSON is read for.
PLAIN = ("id", "produtor_id", "talhao_id", "tipo", "status", "arquivo_origem", "data_emissao", "data_validade")


@dataclass(frozen=True)
class Context:
    produtor: DataFrame
    talhao: DataFrame
    documento: DataFrame
    lote: DataFrame
    lote_talhao: DataFrame
    embargo: DataFrame
    alerta: DataFrame
    protegida: DataFrame
    lista_suja: DataFrame
    as_of: dt.date
    params: Params = field(default_factory=default_params)
    crs: str = "utm22s"
    cell: float = 250.0
    box_shortcut: bool = True
    base_date: str = "desconhecida"
    # Parcels that define who ships in which lot, when ``talhao`` is only a part of them.
    vinculos: DataFrame | None = None

    @property
    def today(self) -> Column:
        return F.lit(self.as_of).cast("date")


    @cached_property
    def docs(self) -> DataFrame:
        """Documents with their extracted fields, parsed once per run."""
        return materialise(parsed_documents(self.documento), "documents")

    def reading(self, *names: str) -> Context:
        """The same context for a job that reads these fields of the documents several times: they alone are parsed and written."""
        out = replace(self)
        out.__dict__["docs"] = materialise(self.fields(*names), "documents")
        return out

    def fields(self, *names: str) -> DataFrame:
        """Only these fields of the documents, for a job that reads them once.

        Taken from the written table when the run has one; otherwise parsed on the way, each
        document once: no JSON where none of them comes from it.
        """
        if "docs" in self.__dict__:
            return self.docs.select(*names)
        if set(names) <= set(PLAIN):
            return self.documento.select(*names)
        return parsed_documents(self.documento).select(*names)


def field_value(name: str) -> Column:
    """Field by canonical name, first filled alias wins."""
    return first_filled(*[F.col(f"f.{alias}") for alias in FIELD_ALIASES[name]])


def with_fields(documento: DataFrame) -> DataFrame:
    """Parse the extracted fields; broken or non-object JSON gives empty fields.

    Exploded from an array of one, so that the text is parsed once per document: Spark would
    else repeat the parse for every alias of every field, in filters and in groupings.
    """
    schema = ", ".join(f"{n} string" for n in FIELD_NAMES)
    return documento.select("*", F.explode(F.array(F.from_json("campos_json", schema))).alias("f"))


def parsed_documents(documento: DataFrame) -> DataFrame:
    """Typed, normalised fields of every document.

    A run of several fact builders writes them once in columns (``Context.docs``), and each
    reader scans what it needs; a job of one reader takes ``Context.fields``.
    """
    d = with_fields(documento)
    area = lenient_number(field_value("area_ha"))
    blank = F.lit("")
    return d.select(
        *PLAIN,
        digits(field_value("cpf_titular")).alias("cpf_titular"),
        digits(field_value("cpf_emitente")).alias("cpf_emitente"),
        fold_name(field_value("proprietario")).alias("proprietario"),
        field_value("proprietario").isNotNull().alias("com_nome"),
        fold_name(field_value("municipio")).alias("municipio"),
        fold_name(field_value("arrendatario")).alias("arrendatario"),
        F.trim(F.coalesce(field_value("numero"), blank)).alias("numero"),
        F.trim(F.coalesce(field_value("serie"), blank)).alias("serie"),
        F.upper(F.trim(field_value("numero_car"))).alias("numero_car"),
        F.lower(F.trim(F.coalesce(field_value("situacao"), blank))).alias("situacao"),
        F.when(area != 0, area).alias("area"),
        F.coalesce("f.talhao_citado", blank).alias("citado"),
        fold_name(F.col("f.talhao_citado")).alias("citado_norm"),
        lenient_date(field_value("vigencia_inicio")).alias("vigencia_inicio"),
        lenient_date(field_value("vigencia_fim")).alias("vigencia_fim"),
    )
