"""Refusals told from answers."""

import pytest
from pyspark.sql import functions as F

from docgrain.functions.answers import is_no_answer

REFUSED = [
    "知识库中未找到相关内容（现有资料仅包含 Java 版快速排序的原理与代码片段，未提供 Python 实现）。",
    "知识库中未找到 **XYZ-2000 整机保修期**的相关内容。",
    "知识库中未找到 **2027 版员工手册** 的任何内容；现有资料中只收录了 **员工手册（2026 版）**。",
    "**知识库中未找到杭州仓的库存清单。** 知识库中唯一的库存类文档是库存清单.xls。",
    "知识库中未找到 **XYZ-1000 售后维修网点电话**的相关内容。技术支持热线 400-888-1000。",
    "知识库中**未找到**关于公司员工班车的任何内容，包括班车线路、班车时刻或班车乘坐规定等。",
    '知识库中没有直接规定"试用期员工能否请年假"的条款，但可以查询到以下相关依据。',
    "知识库中未找到相关内容：现有资料未说明餐补是按天计算还是按月计算。",
    "知识库中没有关于“策略模式适用场景”的正文说明，**策略模式**仅在目录中被列为一条条目，位于第 201 页 [4]。",
    "知识库中没有关于公司年会安排的任何内容。",
    "#### 说明\n\n知识库中**未找到**将 Docker 与传统虚拟机进行直接对比的内容，因此无法给出结论。",
    "#### 结论\n\n知识库中**未找到**直接说明“线程上下文切换会带来哪些开销”的内容 [1][3]。",
    "#### 关于打卡定位范围\n\n知识库中未找到关于考勤打卡**定位范围**的相关规定 [2][3]。",
    "## 回答\n\n**知识库中未找到 2027 版员工手册的任何内容。**",
    "知识库中仅能确认餐补的归属与发放方式，**具体计算方式与金额标准未找到相关内容**。",
    "知识库中只能提供年假的通用规定，具体到试用期员工的适用性未找到相关内容。",
    "关于考勤打卡的**定位范围**（如允许打卡的地理位置、范围半径等），知识库中未找到相关内容。\n\n知识库中与考勤相关的现有规定如下：1. 公司实行标准工时。",
    # Apologies, numbers, qualifiers, blank lines.
    "抱歉，知识库中没有提供该产品的价格。",
    "1. 知识库的库存清单中未找到广州仓这一仓库的库存记录。",
    "对不起知识库里暂未收录这份合同。",
    "\n 　\n### 说明\n\n不好意思，知识库无法提供。",
    "针对报销，知识库内查无记录。",
]
ANSWERED = [
    "知识库中收录了《员工手册（2026 版）》，其中第 4 节规定实习岗试用期为 6 个月。",
    "根据《员工手册》第 4 节，实习岗试用期 6 个月，转正考核为导师评价 + 述职 [1]。",
    "年假天数按司龄计算：满 1 年 5 天，满 3 年 10 天。",
    "知识库中包含员工手册、库存清单、销售数据等 5 份文档。",
    "库存清单.xls 里有上海仓和深圳仓两个 sheet，杭州仓不在其中。",
    "知识库中没有限制使用场景，开发者可以按需调用 [1]。",
    "知识库中有 5 份文档，其中员工手册规定了考勤制度 [2]。",
    "#### 研发岗试用期与转正考核\n\n研发岗**试用期为 3 个月**，转正考核为项目答辩 + 代码评审 [1]。",
    "## 库存查询结果\n\n上海仓 M-1001 当前库存 420.0，高于安全库存线 [1]。",
    "年假天数按司龄计算：满 1 年 5 天，满 3 年 10 天 [1]。另有部分特殊岗位细则知识库未收录。",
    "关于差旅住宿，知识库中没有明文上限，但第八条规定单日不超过一百元 [1]。",
    "",
    None,
    "#### 只有标题",
    "关于" + "很长的话题" * 9 + "，知识库中未找到相关内容",
]


@pytest.mark.parametrize("refused, texts", [(True, REFUSED), (False, ANSWERED)])
def test_refusals(spark, refused, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", is_no_answer(F.col("t")).alias("refused")).collect()
    assert [texts[r["i"]] for r in got if r["refused"] is not refused] == []
