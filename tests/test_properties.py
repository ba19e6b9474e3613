"""The chain of property files above a project."""

from tidemark.operators import properties

GROUP = "<Project><PropertyGroup>{}</PropertyGroup></Project>"


def chain(spark, projects, files):
    found = properties.property_chain(
        spark.createDataFrame(projects, "root string, path string"), spark.createDataFrame(files, "root string, path string, text string")
    )
    return {tuple(r) for r in found.select("root", "project", "name", "value").collect()}


def test_nearest_file_wins_at_every_depth(spark):
    files = [
        ("r", "Directory.Build.props", GROUP.format("<OutputType>root</OutputType><IsTestProject>true</IsTestProject>")),
        ("r", "a/Directory.Build.props", GROUP.format("<OutputType>a</OutputType>")),
        ("r", "a/b/Directory.Build.props", GROUP.format("<TargetFramework>net9.0</TargetFramework>")),
        ("r", "ab/Directory.Build.props", GROUP.format("<OutputType>ab</OutputType>")),
        ("r", "a/b/p.csproj", GROUP.format("<IsTestProject> </IsTestProject>")),
        ("r", "top.csproj", GROUP.format("")),
        ("other", "Directory.Build.props", GROUP.format("<OutputType>other</OutputType>")),
    ]
    got = chain(spark, [("r", "a/b/p.csproj"), ("r", "a/b/p.csproj"), ("r", "top.csproj"), ("r", "a/x/unread.csproj"), ("r", None)], files)
    assert got == {
        ("r", "a/b/p.csproj", "OutputType", "a"),
        ("r", "a/b/p.csproj", "TargetFramework", "net9.0"),
        ("r", "a/b/p.csproj", "IsTestProject", ""),
        ("r", "top.csproj", "OutputType", "root"),
        ("r", "top.csproj", "IsTestProject", "true"),
        ("r", "a/x/unread.csproj", "OutputType", "a"),
        ("r", "a/x/unread.csproj", "IsTestProject", "true"),
    }


def test_values_in_a_file(spark):
    text = """<?xml version="1.0"?>
<Project xmlns="http://schemas.microsoft.com/developer/msbuild/2003"><!-- c -->
  <OutputType>outside</OutputType>
  <PropertyGroup Condition="x"><OutputType>first</OutputType><outputtype>other case</outputtype><Unknown>1</Unknown></PropertyGroup>
  <Choose><When><PropertyGroup><OutputType>a<!-- c -->b <b>c</b></OutputType></PropertyGroup></When></Choose>
  <Target><PropertyGroup><TargetFrameworks>
    net8.0;net9.0 </TargetFrameworks></PropertyGroup></Target>
</Project>"""
    files = [("r", "p", text), ("r", "broken", text[:-5]), ("r", "empty", ""), ("r", "null", None), ("r", "long", GROUP.format("<X>" + "x" * 3_000_000 + "</X><OutputType>l</OutputType>"))]
    got = chain(spark, [("r", f[1]) for f in files], files)
    assert got == {
        ("r", "p", "OutputType", "ab c"),
        ("r", "p", "TargetFrameworks", "net8.0;net9.0"),
        ("r", "long", "OutputType", "l"),
    }


def test_runner_of_the_sdk_file(spark):
    projects = [("r", "a/p"), ("q", "p"), ("none", "p")]
    files = [
        ("r", "global.json", '{"test": {"runner": "Microsoft.Testing.Platform"}}'),
        ("r", "a/global.json", '{"test": {"runner": "not at the root"}}'),
        ("q", "global.json", '{"sdk": {}}'),
        ("none", "global.json", "{broken"),
    ]
    assert chain(spark, projects, files) == {("r", "a/p", "GlobalJsonTestRunner", "Microsoft.Testing.Platform")}


def test_empty_tables(spark):
    assert chain(spark, [], []) == set()
    assert chain(spark, [("r", "p")], []) == set()
