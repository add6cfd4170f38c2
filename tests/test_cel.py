import pytest
from pyspark.sql import functions as F

from quarry.operators import search
from quarry.plans import cel
from quarry.sources import tables

CASES = {
    "7/2==3": True,
    "-7/2==-3": True,
    "-7%2==-1": True,
    "1/0==1": None,
    "1/0==1||true": True,
    "false&&1/0==1": False,
    "9223372036854775807+1>0": None,
    "1.0/0.0>5.0": True,
    "size>5&&is_source": True,
    "is_image": False,
    '"abc".matches("b.")': True,
    "tags.exists(t,t.size()==2)": True,
    'tags.all(t,t.startsWith("x"))': False,
    "tags.map(t,t.size())==[1,2]": True,
    'tags.filter(t,t=="x").size()==1': True,
    '"yy" in tags': True,
    'tags[1]=="yy"': True,
    'tags[5]=="yy"': None,
    "frontmatter.k.n==3": True,
    'frontmatter["s"]=="v"': True,
    "has(frontmatter.zz)": False,
    "has(frontmatter.k)": True,
    'mod_time>timestamp("2024-03-05T06:07:07Z")': True,
    'timestamp("2024-03-05T08:07:08+02:00")==mod_time': True,
    "mod_time.getMonth()==2&&mod_time.getDate()==5&&mod_time.getDayOfWeek()==2": True,
    'mod_time-timestamp("2024-03-05T05:07:08Z")==duration("1h")': True,
    'duration("90m").getHours()==1': True,
    'taken_at<timestamp("2000-01-01T00:00:00Z")': True,
    'int("12")==12': True,
    'int("1x")==1': None,
    "double(3)==3.0": True,
    'string(5)=="5"': True,
    'levenshtein("kitten","sitting")==3': True,
    'levenshtein("café","cafe")==1': True,
    'soundex("O\'Brien")': "O165",
    'soundex("Tymczak")': "T522",
    'soundex("Ashcraft")': "A261",
    'soundex("Pfister")': "P236",
    'soundex("123")': "0000",
    'soundex("")': "0000",
    'ngrams("café",2)==["ca","af","fé"]': True,
    'size(ngrams("abc",4))==0': True,
    'size(ngrams("hello",0))==0': True,
    'ngram_similarity("kubernetes","kubernetez",3)>0.77': True,
    'ngram_similarity("","",2)==1.0': True,
    'ngram_similarity("","hello",2)==0.0': True,
    "point_in_polygon(1.0,1.0,[0.0,0.0,0.0,2.0,2.0,2.0,2.0,0.0])": True,
    "point_in_polygon(3,1,[0,0,0,2,2,2,2,0])": False,
    "point_in_polygon(3,1,[0,0,0])": False,
    "(1/0==1)?true:false": None,
    "true?1:2": 1,
    'secret_kinds("token = \\"0123456789abcdef\\"")==["password_assignment"]': True,
    "!(1/0==1)": None,
    "page_count<5": True,
    "similarity>=0.5": True,
    "size(path)==6": True,
    'image_similar_to("ff",0.9)': False,
    '"a"+"b"=="ab"': True,
    "": True,
}
ERRORS = ["similarity>=0", "sizee>1", "size+", "1u", '"a".matches("(?=x)")', "foo(1)", 'size>"a"', "size", "[1, 'a'].size() > 0", '"a" in 5']


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1).selectExpr("'a/b.py' path", "'source/python' content_type", "10L size", "timestamp_ntz'2024-03-05 06:07:08' mod_time", "array('x','yy') tags", "parse_json('{\"k\":{\"n\":3},\"s\":\"v\"}') frontmatter", "0.5d similarity")


def test_values(one):
    variables = tables.variables(one)
    columns = [cel.Compiler(variables).compile(cel.parse(t)).column.alias(f"c{i}") for i, t in enumerate(CASES)]
    got = dict(zip(CASES, one.select(*columns).first()))
    assert got == CASES


@pytest.mark.parametrize("text", ERRORS)
def test_errors(one, text):
    with pytest.raises(cel.ExpressionError):
        cel.predicate(text, tables.variables(one))


def test_validate_suggests(one):
    found = cel.validate("sizee > 1", tables.variables(one))
    assert not found["ok"] and "'size'" in found["error"]
    assert cel.validate("size > 1 && levenshtein(name, 'x') < 2", tables.variables(one))["variables"] == ["name", "size"]


@pytest.mark.parametrize("name", sorted(search.PRESETS))
def test_presets_compile(one, name):
    assert search.preset(one.withColumn("name", F.lit("x")), name).count() >= 0


def test_pages_cover_all_rows(spark):
    sizes = {"c": 30, "a": 10, "d": 20, "b": 20, "e": 40, "n": None}
    files = spark.createDataFrame([(k, v) for k, v in sizes.items()], "path string, size long")
    for order, want in (("asc", "abdcen"), ("desc", "necbda")):
        token, seen = None, ""
        for _ in range(9):
            page, following = search.page(files, "size", order, 2, token)
            seen += "".join(r.path for r in page.collect())
            found = following.collect()
            if not found:
                break
            token = found[0].cursor
        assert seen == want
    with pytest.raises(ValueError):
        search.page(files, "size", "asc", 2, search.cursor("size", "desc", 1, "a"))
