"""Survey specification: the schema, domains and lookup tables every operator reads.

Schema-wide operators read their columns from a ``SurveySpec``; the scores, encodings and alerts
that are defined on certain answers name them. ``OBESITY`` is the spec of the survey this project was built for.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the published survey definition for right results
# (column list, ranges, category domains, class order, labels, encodings,
# risk levels, interpretation texts, clinical texts, thresholds).
# ---------------------------------------------------------------------------

COLUMNS = [
    "Gender", "Age", "Height", "Weight", "family_history", "FAVC", "FCVC", "NCP",
    "CAEC", "SMOKE", "CH2O", "SCC", "FAF", "TUE", "CALC", "MTRANS", "Obesity",
]

# column -> (min, max, min as printed, max as printed); both ends inclusive
NUMERIC_RANGES = {
    "Age": (10.0, 100.0, "10.0", "100.0"),
    "Height": (1.20, 2.20, "1.2", "2.2"),
    "Weight": (20.0, 250.0, "20.0", "250.0"),
    "FCVC": (0.0, 3.0, "0.0", "3.0"),
    "NCP": (1.0, 4.0, "1.0", "4.0"),
    "CH2O": (0.0, 3.0, "0.0", "3.0"),
    "FAF": (0.0, 3.0, "0.0", "3.0"),
    "TUE": (0.0, 2.0, "0.0", "2.0"),
}

CATEGORICAL_VALUES = {
    "Gender": ["Male", "Female"],
    "family_history": ["yes", "no"],
    "FAVC": ["yes", "no"],
    "CAEC": ["no", "Sometimes", "Frequently", "Always"],
    "SMOKE": ["yes", "no"],
    "SCC": ["yes", "no"],
    "CALC": ["no", "Sometimes", "Frequently", "Always"],
    "MTRANS": ["Automobile", "Bike", "Motorbike", "Public_Transportation", "Walking"],
    "Obesity": [
        "Insufficient_Weight", "Normal_Weight", "Overweight_Level_I", "Overweight_Level_II",
        "Obesity_Type_I", "Obesity_Type_II", "Obesity_Type_III",
    ],
}

CLASS_LABELS_PT = {
    "Insufficient_Weight": "Abaixo do Peso",
    "Normal_Weight": "Peso Normal",
    "Overweight_Level_I": "Sobrepeso Nível I",
    "Overweight_Level_II": "Sobrepeso Nível II",
    "Obesity_Type_I": "Obesidade Tipo I",
    "Obesity_Type_II": "Obesidade Tipo II",
    "Obesity_Type_III": "Obesidade Tipo III",
}

FREQUENCY_ORDINAL = {"no": 0, "Sometimes": 1, "Frequently": 2, "Always": 3}

# analytics (correlation) encoding of the binary columns: case-sensitive, unmapped -> NULL
BINARY_CODES = {
    "Gender": {"Male": 1, "Female": 0},
    "family_history": {"yes": 1, "no": 0},
    "FAVC": {"yes": 1, "no": 0},
    "SMOKE": {"yes": 1, "no": 0},
    "SCC": {"yes": 1, "no": 0},
}

# exploratory "activity" ordinal of the transport column
MTRANS_ACTIVITY = {"Automobile": 0, "Motorbike": 1, "Public_Transportation": 2, "Bike": 3, "Walking": 4}

# alternative all-ordinal encoding of the stand-alone model; defaults for unknown values
MTRANS_ALPHABETICAL = {"Automobile": 0, "Bike": 1, "Motorbike": 2, "Public_Transportation": 3, "Walking": 4}
ALT_DEFAULTS = {"CAEC": 0, "CALC": 0, "MTRANS": 3}

RISK_LEVELS = {
    "Insufficient_Weight": "baixo",
    "Normal_Weight": "baixo",
    "Overweight_Level_I": "moderado",
    "Overweight_Level_II": "moderado",
    "Obesity_Type_I": "alto",
    "Obesity_Type_II": "muito_alto",
    "Obesity_Type_III": "muito_alto",
}
RISK_DEFAULT = "moderado"
RISK_LABELS = {"baixo": "Baixo", "moderado": "Moderado", "alto": "Alto", "muito_alto": "Muito Alto"}
RISK_COLORS = {"baixo": "#22C55E", "moderado": "#EAB308", "alto": "#EF4444", "muito_alto": "#B91C1C"}

FEATURE_INTERPRETATIONS_PT = {
    "Weight": "Peso corporal elevado está diretamente associado à obesidade",
    "BMI_proxy": "IMC elevado é o principal indicador de obesidade",
    "Height": "Altura influencia o IMC e a classificação de peso",
    "Age": "Idade avançada está associada a maior risco de sobrepeso",
    "FCVC": "Baixo consumo de vegetais está associado a pior qualidade alimentar",
    "NCP": "Número de refeições principais influencia o balanço calórico",
    "CH2O": "Baixa ingestão de água está associada a hábitos alimentares menos saudáveis",
    "FAF": "Baixa frequência de atividade física é fator de risco independente",
    "TUE": "Tempo excessivo em telas está associado a sedentarismo",
    "family_history": "Histórico familiar de obesidade aumenta significativamente o risco",
    "FAVC": "Consumo frequente de alimentos calóricos está associado à obesidade",
    "SMOKE": "Tabagismo está associado a alterações metabólicas e de peso",
    "SCC": "Monitoramento calórico está associado a maior consciência alimentar",
    "Gender": "Gênero influencia a distribuição de gordura corporal",
    "CAEC": "Consumo de alimentos entre refeições contribui para excesso calórico",
    "CALC": "Consumo de álcool adiciona calorias e afeta o metabolismo",
}

# BMI interpretation: first threshold with bmi <= t
BMI_BANDS = [(18.5, "Abaixo do Peso", "#3B82F6"), (24.9, "Normal", "#22C55E"),
             (29.9, "Sobrepeso", "#F97316"), (float("inf"), "Obesidade", "#EF4444")]

# contextual alert rules: defaults used when an answer is absent
ALERT_DEFAULTS = {"family_history": "no", "SMOKE": "no", "FAF": 1.0, "FAVC": "no", "CH2O": 2.0}

# form-label decoding (Portuguese label -> dataset value)
GENDER_OPTIONS = {"Masculino": "Male", "Feminino": "Female"}
FREQUENCY_OPTIONS = {"Não": "no", "Às vezes": "Sometimes", "Frequentemente": "Frequently", "Sempre": "Always"}
MTRANS_OPTIONS = {"Automóvel": "Automobile", "Bicicleta": "Bike", "Motocicleta": "Motorbike",
                  "Transporte Público": "Public_Transportation", "Caminhada": "Walking"}
FCVC_OPTIONS = {"Nunca": 0.0, "Às vezes": 1.0, "Frequentemente": 2.0, "Sempre": 3.0}
CH2O_OPTIONS = {"Menos de 1 litro": 0.0, "Entre 1 e 2 litros": 1.0, "Entre 2 e 3 litros": 2.0,
                "Mais de 3 litros": 3.0}
TUE_OPTIONS = {"0 a 2 horas": 0.0, "3 a 5 horas": 1.0, "Mais de 5 horas": 2.0}
YES_LABEL = "Sim"

# class display attributes: icon, colour
CLASS_DISPLAY = {
    "Insufficient_Weight": ("🔵", "#3B82F6"),
    "Normal_Weight": ("🟢", "#22C55E"),
    "Overweight_Level_I": ("🟡", "#EAB308"),
    "Overweight_Level_II": ("🟠", "#F97316"),
    "Obesity_Type_I": ("🔴", "#EF4444"),
    "Obesity_Type_II": ("🔴", "#DC2626"),
    "Obesity_Type_III": ("🔴", "#B91C1C"),
}
DISPLAY_DEFAULT = ("⚪", "#9E9E9E")

CLINICAL_INFO = {
    "Insufficient_Weight": (
        "O peso corporal está abaixo do considerado saudável para a altura. "
        "Pode indicar desnutrição, distúrbios alimentares ou condições médicas subjacentes.",
        ["Deficiências nutricionais (ferro, vitaminas, cálcio)", "Sistema imunológico enfraquecido",
         "Osteoporose e fragilidade óssea", "Anemia", "Problemas de fertilidade"],
        ["Consultar nutricionista para plano alimentar hipercalórico saudável",
         "Realizar exames laboratoriais para identificar deficiências",
         "Praticar exercícios de resistência para ganho de massa muscular",
         "Monitorar peso regularmente com acompanhamento médico"],
    ),
    "Normal_Weight": (
        "O peso corporal está dentro da faixa considerada saudável para a altura. "
        "Manter este estado é fundamental para a saúde a longo prazo.",
        ["Risco cardiovascular e metabólico dentro do esperado para a faixa etária",
         "Atenção à composição corporal (percentual de gordura vs. massa magra)"],
        ["Manter alimentação equilibrada e variada",
         "Praticar pelo menos 150 minutos de atividade física moderada por semana",
         "Realizar check-ups anuais preventivos",
         "Manter hidratação adequada (≥ 2 litros de água por dia)"],
    ),
    "Overweight_Level_I": (
        "O peso está levemente acima do ideal. Este estágio é um sinal de alerta "
        "e o momento mais eficaz para intervenção preventiva.",
        ["Aumento do risco de hipertensão arterial", "Resistência à insulina incipiente",
         "Dores articulares (joelhos, quadril)", "Apneia do sono leve"],
        ["Reduzir consumo de alimentos ultraprocessados e açúcares",
         "Aumentar atividade física para 200–300 min/semana",
         "Monitorar pressão arterial e glicemia regularmente",
         "Consultar nutricionista para ajuste alimentar"],
    ),
    "Overweight_Level_II": (
        "O peso está moderadamente acima do ideal. Intervenção nutricional e "
        "aumento da atividade física são recomendados com urgência.",
        ["Risco elevado de diabetes tipo 2", "Hipertensão arterial",
         "Dislipidemia (colesterol e triglicerídeos alterados)", "Síndrome metabólica",
         "Problemas articulares e musculoesqueléticos"],
        ["Iniciar acompanhamento médico e nutricional estruturado",
         "Adotar dieta com déficit calórico moderado (300–500 kcal/dia)",
         "Praticar exercícios aeróbicos e de resistência regularmente",
         "Realizar exames metabólicos completos (glicemia, lipidograma, TSH)"],
    ),
    "Obesity_Type_I": (
        "Obesidade grau I. O excesso de peso já representa risco significativo "
        "para a saúde cardiovascular e metabólica. Tratamento multidisciplinar é indicado.",
        ["Alto risco de diabetes tipo 2", "Doença cardiovascular (infarto, AVC)",
         "Hipertensão arterial grave", "Apneia obstrutiva do sono",
         "Esteatose hepática (gordura no fígado)", "Refluxo gastroesofágico"],
        ["Tratamento multidisciplinar: médico, nutricionista e educador físico",
         "Avaliação cardiológica e endocrinológica",
         "Programa estruturado de perda de peso (5–10% do peso corporal)",
         "Considerar terapia comportamental para mudança de hábitos"],
    ),
    "Obesity_Type_II": (
        "Obesidade grau II. Risco muito elevado de comorbidades graves. "
        "Intervenção médica intensiva é necessária, podendo incluir farmacoterapia.",
        ["Risco muito alto de eventos cardiovasculares fatais",
         "Diabetes tipo 2 estabelecido ou pré-diabetes avançado", "Insuficiência cardíaca",
         "Trombose venosa profunda", "Problemas renais crônicos", "Depressão e ansiedade associadas"],
        ["Acompanhamento médico intensivo e regular", "Avaliação para farmacoterapia da obesidade",
         "Programa intensivo de mudança de estilo de vida",
         "Suporte psicológico para transtornos alimentares e saúde mental",
         "Monitoramento contínuo de comorbidades"],
    ),
    "Obesity_Type_III": (
        "Obesidade grau III (mórbida). Condição de alto risco que compromete "
        "significativamente a qualidade e expectativa de vida. "
        "Avaliação para cirurgia bariátrica pode ser indicada.",
        ["Risco extremamente elevado de mortalidade cardiovascular",
         "Limitação funcional grave (mobilidade reduzida)", "Insuficiência respiratória e apneia grave",
         "Diabetes tipo 2 de difícil controle", "Hipertensão refratária",
         "Risco cirúrgico aumentado para qualquer procedimento"],
        ["Encaminhamento urgente para equipe especializada em obesidade",
         "Avaliação para cirurgia bariátrica (critérios: IMC ≥ 40 ou ≥ 35 com comorbidades)",
         "Acompanhamento psiquiátrico e psicológico", "Programa de reabilitação física adaptada",
         "Monitoramento intensivo de todas as comorbidades"],
    ),
}

# feature engineering constants
EATING_SCORE_MAX = 12.0
LIFESTYLE_CLIP = (-7.0, 3.0)
STANDARD_COLS = ["Age", "Height", "Weight", "BMI"]
MINMAX_COLS = ["FCVC", "NCP", "CH2O", "FAF", "TUE"]
SEVERE_CLASSES = ["Obesity_Type_I", "Obesity_Type_II", "Obesity_Type_III"]
ACCURACY_GATE = 0.75
RANDOM_STATE = 42
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class SurveySpec:
    """Declarative description of a survey table; operators are generic over it."""

    columns: list = field(default_factory=lambda: list(COLUMNS))
    numeric_ranges: dict = field(default_factory=lambda: dict(NUMERIC_RANGES))
    categorical_values: dict = field(default_factory=lambda: {k: list(v) for k, v in CATEGORICAL_VALUES.items()})
    target: str = "Obesity"
    id_col: str = "id"
    class_labels: dict = field(default_factory=lambda: dict(CLASS_LABELS_PT))
    frequency_ordinal: dict = field(default_factory=lambda: dict(FREQUENCY_ORDINAL))
    ordinal_cols: tuple = ("CAEC", "CALC")
    binary_codes: dict = field(default_factory=lambda: {k: dict(v) for k, v in BINARY_CODES.items()})
    # label encoding for the model features: column -> value that maps to 1 (case-insensitive)
    positive_values: dict = field(default_factory=lambda: {
        "Gender": "male", "FAVC": "yes", "SMOKE": "yes", "SCC": "yes", "family_history": "yes"})
    onehot_col: str = "MTRANS"
    standard_cols: tuple = tuple(STANDARD_COLS)
    minmax_cols: tuple = tuple(MINMAX_COLS)

    @property
    def numeric_cols(self) -> list:
        return list(self.numeric_ranges)

    @property
    def categorical_cols(self) -> list:
        return list(self.categorical_values)

    @property
    def input_cols(self) -> list:
        return [c for c in self.columns if c != self.target]

    @property
    def class_order(self) -> list:
        return list(self.categorical_values[self.target])

    @property
    def onehot_categories(self) -> list:
        return sorted(self.categorical_values[self.onehot_col])

    @property
    def feature_names(self) -> list:
        """The 24 model features in their fixed output order."""
        return [
            *self.standard_cols, *self.minmax_cols,
            "eating_score", "lifestyle_score", "high_calorie_sedentary",
            "Gender", "FAVC", "SMOKE", "SCC", "family_history",
            *self.ordinal_cols,
            *[f"{self.onehot_col}_{c}" for c in self.onehot_categories],
        ]

    @property
    def correlation_features(self) -> list:
        """The 15 analytics features correlated with the target (transport excluded)."""
        return [*self.numeric_cols, *self.binary_codes, *self.ordinal_cols]


OBESITY = SurveySpec()
