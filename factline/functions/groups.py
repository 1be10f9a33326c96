"""Relations by meaning, and vectors for relations without embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.operators.embed import DIMENSIONS, name_vector, unit

#: Relation groups of political event data and of epidemic control (fixed values). Other vocabularies bring a table (relation, group).
GROUPS = {
    "statement": ("Make_statement", "Express_intent_to_cooperate", "Express_intent_to_provide_aid"),
    "visit": ("Make_a_visit", "Host_a_visit", "Meet_with"),
    "conflict": ("Accuse", "Criticize_or_denounce", "Threaten", "Protest_or_demonstrate"),
    "military": ("Fight_with_artillery_and_tanks", "Use_conventional_military_force", "Provide_military_aid"),
    "aid": ("Provide_aid", "Provide_economic_aid", "Cooperate_on_economic_issues"),
    "diplomacy": ("Engage_in_diplomatic_cooperation", "Consult", "Engage_in_negotiation", "Mediate"),
    "agreement": ("Sign_formal_agreement", "Ratify_treaty"),
    "appeal": ("Make_an_appeal_or_request",),
    "discuss": ("Discuss_by_telephone",),
    "apology": ("Apologize",),
    "praise": ("Praise_or_endorse",),
    "med_infection": ("感染", "确诊", "疑似", "无症状", "携带", "发病", "传染", "罹患", "受感染", "被传染", "检出", "阳性", "阴性", "复核", "排除感染", "确诊阳性", "上报", "登记", "筛查", "排查"),
    "med_drug": ("服用", "接种", "开具", "给药", "注射", "输液", "用药", "配药", "疫苗接种", "服用药物", "给药治疗", "用药治疗", "用药缓解", "配药服用", "注射给药", "输液治疗", "用药康复", "接种疫苗"),
    "med_symptom": ("发热", "咳嗽", "乏力", "咽痛", "鼻塞", "流涕", "肌肉酸痛", "头痛", "腹泻", "呕吐", "胸闷", "气促", "呼吸困难", "畏寒", "头晕", "体温上升", "体温下降", "体温升高", "体温降低", "症状缓解", "症状减轻", "症状加重", "体征稳定", "体征平稳"),
    "med_recovery": ("痊愈", "好转", "恶化", "出院", "留观", "康复", "转阴", "治愈", "病情稳定", "病情加重", "病情缓解", "病情观察", "康复出院", "转阴出院", "治愈出院", "好转出院", "康复治疗", "持续治疗"),
    "med_prevention": ("隔离", "管控", "监测", "检测", "消杀", "封控", "管控措施", "隔离观察", "居家隔离", "集中隔离", "健康监测", "核酸检测", "抗原检测", "抗体检测", "环境消杀", "区域封控", "人员管控", "疫情监测", "风险排查", "防护", "消毒", "预检", "分诊", "检疫", "查验"),
    "med_treatment": ("收治", "治疗", "转诊", "监护", "诊断", "救治", "护理", "会诊", "住院", "门诊", "急诊", "留院观察", "重症监护", "专科治疗", "综合救治", "常规治疗", "对症治疗", "支持治疗"),
    "med_spread": ("爆发", "流行", "传播", "溯源", "扩散", "蔓延", "受控", "阻断", "遏制", "平息", "疫情爆发", "病毒传播", "疫情扩散", "疫情蔓延", "疫情受控", "传播阻断", "疫情遏制", "疫情平息"),
    "med_admin": ("报告", "统计", "预警", "处置", "防控", "值守", "督导", "检查", "保障", "支援", "随访", "回访", "疫情报告", "数据统计", "数据上报", "疫情上报", "风险预警", "风险评估", "应急处置", "疫情防控", "医疗保障", "医疗支援", "物资保障", "物资支援", "督导检查", "卫生监督"),
}
NOISE = 0.15


def group_table(spark) -> DataFrame:
    return spark.createDataFrame([(r, g) for g, rs in GROUPS.items() for r in rs], "relation string, group string")


def pseudo_vectors(facts: DataFrame, groups: DataFrame | None = None, dimensions: int = DIMENSIONS) -> DataFrame:
    """(relation, vector): near the centre of the relation's group, or anywhere without one; fixed by the names."""
    groups = group_table(facts.sparkSession) if groups is None else groups
    r = facts.select("relation").distinct().join(groups, "relation", "left")
    own = name_vector(F.concat(F.lit("relation:"), "relation"), dimensions)
    centre = name_vector(F.concat(F.lit("group:"), "group"), dimensions)
    near = unit(F.zip_with(centre, own, lambda c, n: c + NOISE * n))
    return r.select("relation", F.when(F.col("group").isNull(), own).otherwise(near).alias("vector"))
