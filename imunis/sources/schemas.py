"""Typed declarations of the ten programme tables.

Each table has a StructType, its primary key, its foreign keys and the
VARCHAR lengths of the original DDL. The audits (K1, K2, K4) and the change
operators read this metadata instead of repeating it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

S = T.StringType()
I = T.IntegerType()
L = T.LongType()
D = T.DateType()


def _f(name, dtype, nullable=False):
    return T.StructField(name, dtype, nullable)


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    ref_table: str
    ref_columns: tuple[str, ...]
    cascade: bool = False


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: T.StructType
    key: tuple[str, ...]
    foreign_keys: tuple[ForeignKey, ...] = ()
    lengths: dict[str, int] = field(default_factory=dict)
    serial: str | None = None

    @property
    def not_null(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]


CAMPANHA = TableSpec(
    "campanha",
    T.StructType([
        _f("id_campanha", I), _f("nome", S), _f("doenca_alvo", S), _f("tipo_vacina", S),
        _f("data_inicio", D), _f("data_fim", D, True), _f("publico_alvo", S),
    ]),
    key=("id_campanha",),
    lengths={"nome": 100, "doenca_alvo": 100, "tipo_vacina": 30, "publico_alvo": 100},
    serial="id_campanha",
)

VACINA = TableSpec(
    "vacina",
    T.StructType([
        _f("id_vacina", L), _f("nome", S), _f("doenca_alvo", S), _f("codigo_lote", S),
        _f("data_chegada", D), _f("data_validade", D), _f("qtd_doses", I),
    ]),
    key=("id_vacina",),
    lengths={"nome": 100, "doenca_alvo": 100, "codigo_lote": 100},
    serial="id_vacina",
)

LOCAL = TableSpec(
    "local",
    T.StructType([
        _f("id_local", L), _f("nome", S), _f("rua", S), _f("bairro", S), _f("numero", I),
        _f("cidade", S), _f("estado", S), _f("contato", S), _f("capacidade", I, True),
    ]),
    key=("id_local",),
    lengths={"nome": 100, "rua": 100, "bairro": 100, "cidade": 100, "estado": 50, "contato": 100},
    serial="id_local",
)

USUARIO = TableSpec(
    "usuario",
    T.StructType([_f("cpf", S), _f("nome", S), _f("telefone", S)]),
    key=("cpf",),
    lengths={"cpf": 20, "nome": 100, "telefone": 100},
)

CIDADAO = TableSpec(
    "cidadao",
    T.StructType([
        _f("cpf", S), _f("cartao_sus", S, True), _f("rua", S, True), _f("bairro", S, True),
        _f("numero", I, True), _f("cidade", S, True), _f("estado", S, True),
    ]),
    key=("cpf",),
    foreign_keys=(ForeignKey(("cpf",), "usuario", ("cpf",), cascade=True),),
    lengths={"cpf": 20, "cartao_sus": 100, "rua": 100, "bairro": 100, "cidade": 100, "estado": 50},
)

ADMINISTRADOR = TableSpec(
    "administrador",
    T.StructType([_f("cpf", S), _f("local_trabalho", S)]),
    key=("cpf",),
    foreign_keys=(ForeignKey(("cpf",), "usuario", ("cpf",), cascade=True),),
    lengths={"cpf": 20, "local_trabalho": 100},
)

AGENTE_SAUDE = TableSpec(
    "agente_saude",
    T.StructType([_f("cpf", S), _f("email", S), _f("posto_trabalho", S)]),
    key=("cpf",),
    foreign_keys=(ForeignKey(("cpf",), "usuario", ("cpf",), cascade=True),),
    lengths={"cpf": 20, "email": 100, "posto_trabalho": 100},
)

VACINACAO = TableSpec(
    "vacinacao",
    T.StructType([
        _f("id_vacinacao", L), _f("contagem", I), _f("data_aplicacao", D), _f("id_vacina", L),
        _f("cpf", S), _f("id_local", L), _f("id_campanha", I),
    ]),
    key=("id_vacinacao",),
    foreign_keys=(
        ForeignKey(("id_vacina",), "vacina", ("id_vacina",)),
        ForeignKey(("cpf",), "cidadao", ("cpf",)),
        ForeignKey(("id_local",), "local", ("id_local",)),
        ForeignKey(("id_campanha",), "campanha", ("id_campanha",)),
    ),
    lengths={"cpf": 20},
    serial="id_vacinacao",
)

PARENTE = TableSpec(
    "parente",
    T.StructType([_f("id_parentesco", L), _f("cpf_responsavel", S), _f("cpf_parente", S)]),
    key=("id_parentesco",),
    foreign_keys=(
        ForeignKey(("cpf_responsavel",), "cidadao", ("cpf",)),
        ForeignKey(("cpf_parente",), "cidadao", ("cpf",)),
    ),
    lengths={"cpf_responsavel": 20, "cpf_parente": 20},
    serial="id_parentesco",
)

AGENDAMENTO = TableSpec(
    "agendamento",
    T.StructType([
        _f("id_agendamento", L), _f("data_agendamento", D), _f("id_vacina", L),
        _f("id_local", L), _f("cpf", S),
    ]),
    key=("id_agendamento",),
    foreign_keys=(
        ForeignKey(("id_vacina",), "vacina", ("id_vacina",)),
        ForeignKey(("id_local",), "local", ("id_local",)),
        ForeignKey(("cpf",), "cidadao", ("cpf",)),
    ),
    lengths={"cpf": 20},
    serial="id_agendamento",
)

TABLES: dict[str, TableSpec] = {
    t.name: t for t in (CAMPANHA, VACINA, LOCAL, USUARIO, CIDADAO, ADMINISTRADOR,
                        AGENTE_SAUDE, VACINACAO, PARENTE, AGENDAMENTO)
}

# Option lists of the reference's forms.
TIPOS_VACINA = ("Dose Única", "Múltiplas Doses")
ROLE_CIDADAO = "Cidadão"
ROLE_ADMIN = "Administrador"
ROLE_AGENTE = "Agente de Saúde"
ROLE_GENERICO = "Usuário Genérico"


def request_schema(table: str, with_key: bool = True) -> T.StructType:
    """Schema of a change batch for ``table``: ``req_seq`` + the table columns."""
    spec = TABLES[table]
    fields = [T.StructField("req_seq", L, False)]
    for f in spec.schema.fields:
        if not with_key and spec.serial == f.name:
            continue
        fields.append(T.StructField(f.name, f.dataType, True))
    return T.StructType(fields)
