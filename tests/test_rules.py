"""The rules over texts that hold their words: each query against its oracle on small tables, and rows that are known."""

import duckdb
import pytest

from tessera import registry
from test_oracles import norm

registry.load()
TEXTS = (
    (1, "FAKRA 连接器采用 LCP 注塑, 阻抗: 50 Ω, 温度范围: -40~105℃, 执行 GB/T\n157-2001"),
    (2, "MLG12-45 与 mini-fakra, 黄铜 电镀 镀金, 额定电压 60 V, 接触电阻 10 mΩ, ISO 9001:2015"),
    (3, "PBT GF30 注塑 件, PA66 不是 PA660, GB/T 1 为碎片, 频率 6 GHz, 插拔寿命 500 次"),
    (4, ""),
    (5, "陶瓷 USB HDMI M12 usb, 耐压 1.5 kV, 爬电距离 3 mm, QC/T 417.1-2001 与 GB/T 157"),
)
ASKED = ("MLG12 的阻抗是多少", "GB/T 157 标准", "黄铜和镀金有什么区别", "为什么选 LCP 材料", "怎么安装连接器", "连接器的插拔寿命要求标准和镀金层厚度要求说明", "今天天气怎么样", "你好", "库里有多少文件", "", "对比两种方案的优缺点", "帮我翻译一句话")
TURNS = ((1, 1, "user", "FAKRA 的阻抗"), (1, 2, "assistant", "50 Ω"), (1, 3, "user", "它的寿命"), (1, 4, "user", "价格"), (1, 5, "user", "黄铜 镀金 工艺 说明"), (2, 1, "user", "那个呢"), (2, 2, "user", "那个怎么样"))
SERVERS = (("a/brave-search", "Brave", "web search and fetch"), ("b/notes", "Notes", "vector database of documents, semantic search"), ("c/exa-brave", "", "search"), ("d/game", "Game", "chess"))
PAPERS = ((1, "泛微使用手册.pdf", "后台设置"), (2, "连接器设计手册.docx", "端子"), (3, "标准件新表.xlsx", "供应商 型号 图片"), (4, "标准件.xlsx", "gb/t 65"), (5, "x.txt", "齿轮与轴承"), (6, "y.txt", "随笔"), (7, "飞书操作指南.md", ""))
HAN = ((1, "連接器電鍍後"), (2, "后面"), (3, "國學 テスト 點"), (4, ""), (5, None))
NAMES = ["gr01_rule_entities", "gr03_parameters", "gr09_suitable_processes", "gr19_file_rules", "gr19_rule_edges", "rt02_query_route", "rt03_query_class", "rt27_intent", "rt28_complexity", "rt24_exact_entity", "rt26_rule_rewrite", "rt25_pointing_turns", "rt35_server_relevance", "tx11_document_category", "tx12_system_folder", "tx13_kind_authority", "tx22_simplify"]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """A folder of tables: texts as documents (papers have their name as source), queries as benchmark, turns, servers as pages."""
    d = str(tmp_path_factory.mktemp("rules"))
    docs = [(i, x, "zh", "doc") for i, x in TEXTS] + [(100 + i, x, "zh", n) for i, n, x in PAPERS] + [(200 + i, x, "zh", "han") for i, x in HAN]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) as n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(ASKED)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(list(TURNS), "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(i, a, f"{b} {c}") for i, (a, b, c) in enumerate(SERVERS)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.mark.parametrize("name", NAMES)
def test_rule(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet/*.parquet'")
    rel = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in rel.description]
    want = sorted((tuple(norm(dict(zip(names, r))[c]) for c in cols) for r in rel.fetchall()), key=str)
    assert got == want and got


def rows(spark, data, name, key):
    return {r[key]: r for r in registry.QUERIES[name](spark, data).collect()}


def test_known_rows(spark, data):
    names = {(r["id"], r["name"]) for r in registry.QUERIES["gr01_rule_entities"](spark, data).collect()}
    assert {(1, "FAKRA"), (1, "LCP"), (1, "GB/T 157"), (2, "MLG12-45"), (2, "黄铜"), (3, "PA66"), (5, "陶瓷")} <= names and (3, "PA660") not in names and (3, "GB/T 1") not in names
    route = rows(spark, data, "rt02_query_route", "qid")
    assert [route[i]["route"] for i in (0, 1, 2, 3, 9)] == ["exact", "exact", "material", "material", "general"]
    kind = rows(spark, data, "tx11_document_category", "id")
    assert [kind[100 + i]["category"] for i in (1, 2, 5, 6)] == ["操作手册", "连接器", "机械设计", "未分类"]
    turns = {(r["conv"], r["turn"]): r["resolved"] for r in registry.QUERIES["rt25_pointing_turns"](spark, data).collect()}
    assert turns[1, 3] == "FAKRA 的阻抗 寿命" and turns[1, 5] == "黄铜 镀金 工艺 说明"
