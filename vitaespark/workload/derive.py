"""Domain tables derived from the given parquet tables.

The given tables hold prose, orders and events.  The expressions below turn every one
of their rows into résumés, postings, applications, dialog turns and call logs.  They
are plain SQL that Spark and the checking database read alike, so both start from
exactly the same rows.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NL = "chr(10)"


def _pick(key: str, *values: str) -> str:
    """CASE over the remainder of a key, so that values rotate through all rows."""
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE ({key}) % {len(values)} {whens} END"


def _text(number: str) -> str:
    return f"cast({number} as string)"


# Résumé text: contact block, headed sections and the whole document text.
RESUME_TEXT = f" || {NL} || ".join([
    _pick("doc_id", "姓名：", "姓 名: ", "", "  ") + " || "
    + _pick("doc_id", "李雷", "欧阳娜娜", "韩梅", "张三丰", "王小明"),
    _pick("doc_id", "电话 ", "手机:", "Tel ", "QQ ") + f" || '1' || {_text('3 + doc_id % 7')} || "
    + f"lpad({_text('(doc_id * 7919) % 1000000000')}, 9, '0')",
    _pick("doc_id", "mail", "", "post.box+a") + f" || {_text('doc_id')} || "
    + _pick("doc_id", "@example.com", "@mail.example.org", " at example"),
    _pick("doc_id", "", "现居杭州", "常驻上海和北京"),
    "''",
    _pick("doc_id", "Education", "教育经历", "Education", "Academic History", "Schooling notes"),
    _pick("doc_id", "2018.9 - 2022.6 浙江大学 专业：", "2015/09-2019/7 清华大学, Major: ", "2010年9月至2014年6 同济学院 ")
    + " || " + _pick("doc_id", "计算机科学", "金融", "软件工程", "Law") + " || " + _pick("doc_id", " 硕士", " 本科", " PhD", ""),
    "''",
    _pick("doc_id", "Work Experience", "工作经历", "Employment", "Jobs so far"),
    _pick("doc_id", "2022.07 - 至今 阿里云科技有限公司", "2019-03 ~ present Globex Inc.", "2020.3—2021.12 数据网络集团"),
    _pick("doc_id", "负责平台, 提升了30%, 带领 12 人", "GMV 5亿+ 增长约 45%", "管理8人 ROI > 3"),
    "text",
    "''",
    _pick("doc_id", "Skills", "专业技能", "Tech Stack"),
    _pick("doc_id", "Python, JavaScript, Redis", "Java Spark SQL", "golang / C++ / Docker", "Power BI, Excel"),
    _pick("doc_id", "CET-6", "tab" + "' || chr(9) || '" + "and  two   spaces", "end-"),
    _pick("doc_id", "to be con-", "line", "wise"),
    _pick("doc_id", "tinued", "7", "第 1 页 共 3 页", "Page 2 of 9", "page 4"),
    _text("doc_id % 90"),
    "''", "''", "''", "''",
    _pick("doc_id", "Profile", "Summary", "Awards", "第3页"),
    _pick("doc_id", "last line", "Education", ""),
])

# Posting text: posting fields around the whole document text.
POSTING_TEXT = f" || {NL} || ".join([
    _pick("doc_id", "高级工程师（Java）", "数据分析师", "Senior Engineer (ML)", "we are looking for people"),
    _pick("doc_id", "星海科技有限公司", "Initech Co., Ltd.", "北方银行", "the usual"),
    _pick("doc_id", "工作地点 深圳", "Remote", "远程办公", "on site"),
    _pick("doc_id", "15k-25k", "8千到12千", "2万-3万", "20K 至 30K", "面议"),
    _pick("doc_id", "3年以上 5年 3 years 10 years", "3年以上", "2 years experience", "45年历史", "1-年"),
    _pick("doc_id", "本科及以上", "硕士", "学历不限", "EMBA", "degree"),
    _pick("doc_id", "Python python Go", "JavaScript, Java开发", "K8s / Kubernetes, Spring Boot", "C# .NET"),
    "text",
])

# Reply of a model to the document: plain, fenced, in prose, broken or empty.
_JSON = (
    """'{"position":"' || """ + _pick("doc_id", "Data Engineer", "", "Analyst")
    + """ || '","company":"' || """ + _pick("doc_id", "Acme", "", "", "Globex")
    + """ || '","hard_skills":["' || """ + _pick("doc_id", "Python", "Hive", "Spark")
    + """ || '","' || """ + _pick("doc_id", "SQL", "Docker") + """ || '"],"n":' || """ + _text("doc_id") + " || '}'"
)
MODEL_REPLY = (
    f"CASE doc_id % 6 WHEN 0 THEN {_JSON}"
    f" WHEN 1 THEN 'Here it is: ```json ' || {_JSON} || ' ``` as asked.'"
    f" WHEN 2 THEN 'Answer ' || {_JSON} || ' done'"
    f" WHEN 3 THEN '{{broken ' || lang"
    f" WHEN 4 THEN '```json {{bad}} ``` then ' || {_JSON}"
    f" ELSE '' END"
)

SKILL_NAMES = [
    "Python", "Java", "Go", "Rust", "React", "Redis", "Docker", "Kafka", "Spark", "SQL", "Hive",
    "Flink", "Linux", "Git", "Excel", "Tableau",
]


def _skill(key: str) -> str:
    return _pick(key, *SKILL_NAMES)


# part -> posting, customer -> candidate, orders -> jobs, lineitem -> applications
POSTING = {
    "jd_id": "p_partkey",
    "position": _pick("p_partkey", "Engineer", "Analyst", "", "Designer"),
    "company": "p_brand",
    "years_required": f"CASE WHEN p_size % 9 = 0 THEN '' ELSE {_text('p_size % 24')} || '年' END",
    "education_required": _pick("p_partkey", "本科", "硕士", "不限"),
    "skill_1": _skill("p_partkey"), "skill_2": _skill("p_partkey * 5 + p_size"),
    "skill_3": _skill("p_size * 3 + 1"),
    "soft_1": "p_name", "soft_2": _pick("p_size", "teamwork", "urgent", "medium"),
}
CANDIDATE = {
    "resume_id": "c_custkey",
    "name": "CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN NULL ELSE c_name END",
    "phone": f"CASE c_custkey % 5 WHEN 0 THEN '+86 13' || lpad({_text('c_custkey')}, 9, '0') WHEN 1 THEN '138-' || "
             f"lpad({_text('c_custkey % 10000')}, 4, '0') || '-0000' WHEN 2 THEN '12' || {_text('c_custkey')} WHEN 3 THEN NULL "
             f"ELSE '15' || lpad({_text('c_custkey')}, 9, '0') END",
    "email": f"CASE c_custkey % 4 WHEN 0 THEN 'c' || {_text('c_custkey')} || '@example.com' WHEN 1 THEN 'no mail' "
             f"WHEN 2 THEN '' ELSE 'x' || {_text('c_custkey')} || '@sub.example.org' END",
    "city": _pick("c_nationkey", "杭州", "上海", "", "北京"),
    "target_job": _pick("c_custkey", "Engineer", "", "Analyst", ""),
    "expect_salary": f"{_text('cast(floor(abs(c_acctbal)) as bigint)')} || 'k'",
    "list_skill_1": _skill("c_custkey * 3"), "list_skill_2": _skill("c_custkey + 7"),
    "list_skill_3": _pick("c_custkey", "CET-6", "英语", "Javascript basics", "golang", "Power BI"),
    "school": _pick("c_custkey", "浙江大学", "MIT", ""), "major": _pick("c_custkey", "Physics", "", "金融", "Law"),
    "degree": _pick("c_custkey", "本科", "", "PhD"),
    "language": _pick("c_custkey", "English", "Deutsch"), "certificate": _pick("c_nationkey", "PMP", "CPA", "CFA"),
}
JOB = {
    "resume_id": "o_custkey", "order_key": "o_orderkey", "started": "o_orderdate",
    "company": f"'Shop ' || {_text('o_orderkey % 97')}",
    "position": _pick("o_orderkey", "clerk", "lead", ""),
    "start_date": f"{_text('year(o_orderdate)')} || '.' || {_text('month(o_orderdate)')}",
    "end_date": f"CASE o_orderkey % 5 WHEN 0 THEN '至今' WHEN 1 THEN NULL WHEN 2 THEN "
                f"{_text('year(o_orderdate) - 1')} || '.12' ELSE {_text('year(o_orderdate) + 2')} || '.6' END",
    "duties": f"'Used ' || {_skill('o_orderkey')} || ' and ' || lower({_skill('o_orderkey * 3 + 2')}) || ' on ' || "
              f"lower(o_orderpriority) || {_pick('o_orderkey', ' work', ' work, grew 30%', ' work', ' medium job')} || "
              f"CASE WHEN o_orderkey % 7 = 0 THEN ' 提升很多' ELSE '' END",
    "is_project": "o_orderstatus = 'P'",
}

# events -> call log
CALL = {
    "call_id": "event_id", "tenant": "user_id", "ts": "ts",
    "task_type": _pick("event_id", "jd_parse", "interview", "enquiry", "unknown_task", "vision"),
    "model": "CASE event_type WHEN 'view' THEN 'deepseek_lite' WHEN 'click' THEN 'doubao' "
             "WHEN 'error' THEN 'gpt' WHEN 'purchase' THEN 'claude' ELSE 'gemini' END",
    "success": "event_type <> 'error'",
    "error": "CASE WHEN event_type = 'error' THEN " + _pick("event_id", "NETWORK_ERROR", "HTTP_500", "RATE_LIMITED")
             + " END",
    "prompt_tokens": "cast(floor(value * 10) as bigint)",
    "completion_tokens": "cast(floor(value * 3) as bigint)",
    "latency_ms": "value",
}

TURN = {
    "conv_id": "conv_id", "turn": "turn", "role": "role", "text": "text",
    "said": "CASE WHEN role = 'user' AND turn % 4 = 2 THEN " + _pick("conv_id", "continue", " Next ", "go on!", "next question")
            + " WHEN role = 'user' AND turn % 6 = 0 THEN " + _pick("conv_id", "继续", "下一题吧", "你好")
            + " ELSE text END",
    "lang": _pick("conv_id", "en", "zh"),
    "persona": _pick("conv_id", "hr", "tech", "nobody"),
}


def as_sql(columns: dict[str, str], table: str) -> str:
    """The SELECT that derives a table, for the checking database."""
    return "SELECT " + ", ".join(f"{expr} AS {name}" for name, expr in columns.items()) + f" FROM {table}"


def as_frame(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def resume_texts(spark, folder) -> DataFrame:
    return as_frame(load(spark, folder, "documents"), {"doc_id": "doc_id", "text": RESUME_TEXT})


def posting_texts(spark, folder) -> DataFrame:
    return as_frame(load(spark, folder, "documents"), {"doc_id": "doc_id", "text": POSTING_TEXT})


RESUME_TEXT_SQL = as_sql({"doc_id": "doc_id", "text": RESUME_TEXT}, "documents")
POSTING_TEXT_SQL = as_sql({"doc_id": "doc_id", "text": POSTING_TEXT}, "documents")


def postings(spark, folder) -> DataFrame:
    """One posting per part."""
    rows = as_frame(load(spark, folder, "part"), POSTING)
    return rows.selectExpr(
        "jd_id", "position", "company", "years_required", "education_required",
        "array(skill_1, skill_2, skill_3) AS hard_skills", "array(soft_1, soft_2) AS soft_skills",
        "array(company) AS industry")


def jobs(spark, folder) -> DataFrame:
    return as_frame(load(spark, folder, "orders"), JOB)


_NO_JOBS = (
    "cast(array() AS array<struct<company:string,position:string,start_date:string,end_date:string,duties:string,"
    "achievements:array<string>,source_index:array<int>>>)"
)
_NO_PROJECTS = (
    "cast(array() AS array<struct<name:string,description:string,results:string,source_index:array<int>>>)"
)


def resumes(spark, folder) -> DataFrame:
    """One résumé per customer, with the customer's orders as jobs and some of them as projects.

    Orders are gathered as they are read: the texts of a job are several times as long and made from them afterwards.
    """
    read = [c for c in load(spark, folder, "orders").columns if any(re.search(rf"\b{c}\b", e) for e in JOB.values())]
    job = ", ".join(f"'{name}', " + re.sub(rf"\b({'|'.join(read)})\b", r"o.\1", JOB[name]) for name in (
        "started", "order_key", "company", "position", "start_date", "end_date", "duties", "is_project"))
    history = load(spark, folder, "orders").groupBy(F.col("o_custkey").alias("resume_id")).agg(
        F.collect_list(F.struct(*[c for c in read if c != "o_custkey"])).alias("orders")
    ).selectExpr("resume_id", f"array_sort(transform(orders, o -> named_struct({job}))) AS h")
    nested = history.selectExpr(
        "resume_id",
        "transform(h, j -> named_struct('company', j.company, 'position', j.position, 'start_date', j.start_date,"
        " 'end_date', j.end_date, 'duties', j.duties, 'achievements', cast(array() AS array<string>),"
        " 'source_index', cast(array() AS array<int>))) AS work",
        "transform(filter(h, j -> j.is_project), j -> named_struct('name', 'Project ' || cast(j.order_key AS string),"
        " 'description', j.duties, 'results', '', 'source_index', cast(array() AS array<int>))) AS made")
    people = as_frame(load(spark, folder, "customer"), CANDIDATE)
    return people.join(nested, "resume_id", "left").selectExpr(
        "resume_id",
        "named_struct('name', name, 'phone', phone, 'email', email, 'city', city, 'target_job', target_job,"
        " 'expect_salary', expect_salary, 'onboard_time', cast(null AS string)) AS basic_info",
        "array(named_struct('school', school, 'major', major, 'degree', degree, 'start_date', '2010.9', 'end_date',"
        " '2014.6', 'awards', cast(array() AS array<string>), 'source_index', cast(array() AS array<int>))) AS education",
        f"coalesce(work, {_NO_JOBS}) AS work_experience",
        f"coalesce(made, {_NO_PROJECTS}) AS projects",
        "array(named_struct('name', list_skill_1, 'category', '工具', 'source', 'resume'), named_struct('name', list_skill_2,"
        " 'category', 'AI工具', 'source', 'resume'), named_struct('name', list_skill_3, 'category', '工具', 'source',"
        " 'resume')) AS skills",
        "array(named_struct('name', certificate)) AS certificates",
        "array(named_struct('name', language)) AS languages")


def applications(spark, folder) -> DataFrame:
    """Distinct (posting, candidate) pairs: a candidate applies to the postings of the ordered parts."""
    items = load(spark, folder, "lineitem").select("l_orderkey", F.col("l_partkey").alias("jd_id"))
    orders = load(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("resume_id"))
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("jd_id", "resume_id").distinct()


def calls(spark, folder) -> DataFrame:
    return as_frame(load(spark, folder, "events"), CALL)


def turns(spark, folder) -> DataFrame:
    return as_frame(load(spark, folder, "conversations"), TURN)
