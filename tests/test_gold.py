import pytest
from pyspark.sql import functions as F

from fixtures import by, seven_conversations
from prosa.operators import charts, competition, leads, personas, segments, sellers, sentiment, timing
from prosa.params import NOTEBOOK

EXPECTED = {
    # id: sentiment, label, persona, confidence, lead score, depth, speed, duration, quality
    "conv_001": (0.68, "positivo", "Pesquisador", 0.6000000000000001, 73.3, "alto", "rapido", "curta", "alta_qualificacao"),
    "conv_002": (-0.397, "negativo", "Fantasma", 0.9, 25.0, "baixo", "moderado", "curta", "baixa_qualificacao"),
    "conv_003": (0.635, "positivo", "Decidido", 0.9, 70.3, "medio", "moderado", "media", "alta_qualificacao"),
    "conv_004": (-0.53, "negativo", "Fantasma", 0.9, 5.0, "baixo", "sem_dados", "flash", "baixa_qualificacao"),
    "conv_005": (0.114, "neutro", "Negociador", 1.0, 86.8, "alto", "rapido", "media", "alta_qualificacao"),
    "conv_006": (0.325, "positivo", "Pesquisador", 0.8999999999999999, 41.7, "medio", "moderado", "media", "media_qualificacao"),
    "conv_007": (0.29, "positivo", "Indeciso", 0.5, 27.0, "baixo", "moderado", "curta", "baixa_qualificacao"),
}


@pytest.fixture(scope="module")
def seven(spark):
    return seven_conversations(spark).cache()


def test_per_conversation_results(seven):
    mood = by(sentiment.gold_sentiment(seven), "conversation_id")
    persona = by(personas.gold_personas(seven), "conversation_id")
    score = by(leads.gold_analytics(seven), "conversation_id")
    parts = by(segments.gold_segmentation(seven), "conversation_id")
    for cid, expected in EXPECTED.items():
        got = (mood[cid]["sentimento_score"], mood[cid]["sentimento"], persona[cid]["persona"],
               persona[cid]["persona_confianca"], score[cid]["lead_score"], parts[cid]["seg_engajamento"],
               parts[cid]["seg_velocidade_resposta"], parts[cid]["seg_duracao"], parts[cid]["seg_qualificacao_lead"])
        assert got == expected, cid
    assert mood["conv_001"]["sentimento_fatores"] == "outcome=0.9 eng=0.4 resp=0.4 dur=0.6"
    assert persona["conv_002"]["persona_fatores"] == "fan=0.9 dec=0.0 neg=0.0 pes=0.0 ind=0.2"
    assert parts["conv_005"]["seg_regiao"] == "sul" and parts["conv_007"]["seg_regiao"] == "nordeste"
    assert parts["conv_006"]["seg_origem"] == "indicacao" and parts["conv_002"]["seg_origem"] == "facebook"


def test_sellers(seven):
    rows = by(sellers.seller_metrics(seven), "agent_id")
    names = ("total_conversas", "taxa_conversao_pct", "taxa_ghosting_pct", "media_tempo_resposta_sec", "media_mensagens",
             "media_duracao_minutos", "media_msgs_lead", "conversas_com_concorrente", "score_vendedor")
    assert tuple(rows["marcos"][n] for n in names) == (3, 33.33, 33.33, 211.7, 15.3, 61.7, 8.0, 2, 36.0)
    assert tuple(rows["ana"][n] for n in names) == (4, 25.0, 25.0, 216.7, 6.8, 93.0, 3.0, 1, 33.5)
    stats = sellers.seller_stats(sellers.seller_metrics(seven)).first()
    assert (stats["total_vendedores"], stats["melhor_taxa_conversao"], stats["pior_taxa_conversao"]) == (2, 33.33, 25.0)
    ranks = by(sellers.seller_ranking(sellers.seller_metrics(seven)), "agent_id")
    assert ranks["marcos"]["posicao_geral"] == 1 and ranks["ana"]["posicao_eficiencia"] == 2
    other = by(sellers.seller_metrics(seven, NOTEBOOK), "agent_id")
    assert other["marcos"]["score_vendedor"] == 52.5 and "ghosting_count" in other["ana"].asDict()


def test_funnel_and_rates(spark, seven):
    rows = by(leads.funnel(seven), "conversation_outcome")
    assert sum(r["contagem"] for r in rows.values()) == 7
    assert abs(sum(r["percentual"] for r in rows.values()) - 100) < 0.1
    assert rows["ghosting"]["percentual"] == 28.57
    assert leads.funnel(seven.where("false")).count() == 0
    rates = leads.overall_rates(seven).first()
    assert (rates["taxa_conversao_pct"], rates["taxa_propostas_pct"], rates["taxa_perda_pct"]) == (28.57, 14.29, 14.29)
    assert leads.overall_rates(seven.where("false")).first()["taxa_conversao_pct"] is None


def test_campaigns_and_scores(seven):
    scored = leads.with_lead_score(seven)
    rows = by(leads.campaign_ranking(leads.campaign_performance(scored)), "campaign_id")
    assert rows["google"]["total_conversas"] == 3 and rows["google"]["taxa_conversao_pct"] == 33.33
    assert rows["google"]["posicao"] == 1 and rows["landing"]["posicao"] == 2
    assert "media_lead_score" not in leads.campaign_performance(seven).columns
    stats = leads.score_stats(scored).first()
    assert (stats["lead_score_mediano"], stats["campanhas"]) == (41.7, 2)
    assert leads.describe(scored, "lead_score").first()["max"] == 86.8
    assert all(0 <= r["lead_score"] <= 100 for r in scored.collect())
    plain = seven.drop("has_cpf", "has_email", "has_phone", "lead_plate")
    assert by(leads.with_lead_score(plain), "conversation_id")["conv_001"]["lead_score"] == 50.0
    assert {r["seg_qualificacao_lead"] for r in segments.with_segments(plain).collect()} == {"desconhecido"}


def test_notebook_values(seven):
    persona = by(personas.gold_personas(seven, NOTEBOOK), "conversation_id")
    assert (persona["conv_001"]["persona"], persona["conv_001"]["persona_confianca"]) == ("negociador", 0.4)
    assert (persona["conv_005"]["persona"], persona["conv_005"]["persona_confianca"]) == ("negociador", 0.7)
    assert persona["conv_002"]["persona"] == "fantasma" and persona["conv_006"]["persona"] == "pesquisador"
    score = by(leads.gold_analytics(seven, NOTEBOOK), "conversation_id")
    assert score["conv_001"]["lead_score"] == 61.3  # 15 + 18 + 13.33 + 15, no vehicle
    seg = by(segments.gold_segmentation(seven, NOTEBOOK), "conversation_id")
    assert seg["conv_004"]["seg_velocidade_resposta"] == "desconhecido" and seg["conv_001"]["seg_veiculo"] == "sem_veiculo"


def test_segments_crossed(seven):
    gold = segments.gold_segmentation(seven)
    spread = segments.distribution(gold, ["seg_veiculo"]).collect()
    assert {r["value"]: r["conversas"] for r in spread} == {"com_veiculo": 3, "sem_veiculo": 4}
    cube = segments.crossing(gold, ["seg_regiao", "seg_engajamento"], totals=True)
    top = cube.where("seg_regiao IS NULL AND seg_engajamento IS NULL").first()
    assert (top["conversas"], top["vendas"]) == (7, 2)
    hours = segments.with_hours_segment(seven.withColumn("proporcao_horario_comercial", F.lit(0.5)))
    assert hours.first()["seg_horario"] == "comercial"


def test_time_and_competition(seven):
    assert timing.time_to_close(seven).first()["tempo_medio_fechamento_min"] == 60.0
    assert timing.daily_volume(seven).count() == 4
    assert sum(r["total_conversas"] for r in timing.by_weekday(seven).collect()) == 7
    assert by(timing.by_hour(seven), "hora")[9]["vendas"] == 2
    loss = by(competition.loss_by_mention(seven), "menciona_concorrente")
    assert (loss[True]["taxa_perda_pct"], loss[False]["taxa_perda_pct"]) == (33.33, 0.0)
    cross = by(competition.outcome_cross(seven), "concorrente")
    assert cross["porto seguro"]["venda_fechada"] == 1 and cross["porto seguro"]["ghosting"] == 0
    region = by(competition.top_per_region(segments.with_segments(seven)), "seg_regiao")
    assert region["sudeste"]["concorrente"] == "azul seguros" and region["sul"]["mencoes"] == 1


def test_charts(spark, seven):
    fall = charts.waterfall(seven).collect()
    assert [r["rotulo"] for r in fall] == ["Total de Leads", "Proposta Enviada", "Venda Fechada", "Ghosting", "Perdido Concorrente"]
    assert [r["valor"] for r in fall] == [7, -1, 2, -2, -1]
    stored = leads.funnel(seven)
    assert [tuple(r) for r in charts.waterfall(stored, "contagem").collect()] == [tuple(r) for r in fall]
    assert charts.conversion_rate(stored, "contagem").collect() == charts.conversion_rate(seven).collect()
    other = seven.withColumn("conversation_outcome", F.when(F.col("conversation_id") == "conv_001", None).otherwise("contato_inicial"))
    assert charts.waterfall(other).first()["valor"] == 7
    named = competition.outcome_cross(other).agg(F.sum("outros")).first()[0]
    assert named == seven.where("competitor_mentioned IS NOT NULL").count()
    cells = charts.cross_counts(segments.with_segments(seven), "seg_regiao", "seg_origem")
    assert cells.agg(F.sum("quantidade")).first()[0] == 7
    assert charts.cross_columns(seven.select("conversation_id", "conversation_outcome", "agent_id"), 5) == ["conversation_outcome", "agent_id"]
    counts = charts.category_counts(seven, "conversation_outcome").collect()
    assert counts[0]["rotulo"] == "Ghosting" and counts[0]["pct"] == 28.6
    edge = spark.createDataFrame([(0.0,), (100.0,), (5.0,), (None,)], "lead_score double")
    assert {r["faixa"]: r["quantidade"] for r in charts.histogram(edge, "lead_score").collect()} == {0: 1, 1: 1, 19: 1}
    box = by(charts.box_statistics(leads.with_lead_score(seven), "conversation_outcome", "lead_score"), "conversation_outcome")
    assert (box["ghosting"]["minimo"], box["ghosting"]["mediana"], box["ghosting"]["maximo"]) == (5.0, 15.0, 25.0)
    assert charts.first_groupable(seven.select("conversation_id", "agent_id"), 3) == "agent_id"
    assert charts.fallback_counts(seven.select("total_messages")) is None
    shares = by(charts.sentiment_shares(sentiment.gold_sentiment(seven).drop("sentimento")), "categoria")
    assert shares["positivo"]["quantidade"] == 4


def test_module_names(spark):
    text = spark.createDataFrame([("# KPIs\n## 1. Funil de Conversão\nx\n## Pré-análise (A/B)\n## Notas de Implementação\n### 2. Não\n",)], "text string")
    assert [r["modulo"] for r in charts.kpi_modules(text).orderBy("ordem").collect()] == ["funil_de_conversao", "pre_analise_ab"]
