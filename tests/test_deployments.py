from millrace.sources.deployments import deployed_as, deployments, documents

OBJECTS = """# two objects and a service
apiVersion: apps/v1
kind: Deployment
metadata:
  labels: {app: "a: b", tier: [x, "y, z"]}
  name: cart-api   # the name
spec:
  template:
    spec:
      containers:
      - name: api
        image: "registry/cart:1.2"
        env:
          - name: DB_URL
            value: 'it''s # no remark'
          - {name: MODE, value: fast}
        ports:
          - containerPort: 8080
          - {containerPort: 9090}
        args: ["--a", '--b']
      - image: sidecar
        name: proxy
        command:
        - sh
        - -c
        - |
          echo "name: not a key"
          # kept
---
kind: Service
metadata: {name: cart}
---

---  # another
kind: CronJob
metadata:
  name: nightly
spec:
  schedule: "0 1 * * *"
  jobTemplate:
    spec:
      template:
        spec:
          containers:
            -
              name: job
              image: tool
---
kind: Job
metadata:
  name: "{{ .Release.Name }}"
"""
COMPOSE = """version: '3'
services:
  web:
    image: web:1
    ports: ["80:8080", 443:8443/tcp]
    environment:
      A: 1
      B: two
  db:
    environment:
      - C=3
      - D
    ports:
      - target: 5432
volumes:
  data:
"""


def test_documents():
    a, service, cron, job = documents(OBJECTS)
    assert a["metadata"] == {"labels": {"app": "a: b", "tier": ["x", "y, z"]}, "name": "cart-api"}
    api, proxy = a["spec"]["template"]["spec"]["containers"]
    assert api["env"] == [{"name": "DB_URL", "value": "it's # no remark"}, {"name": "MODE", "value": "fast"}] and api["args"] == ["--a", "--b"]
    assert proxy["command"] == ["sh", "-c", 'echo "name: not a key"\n# kept'] and proxy["name"] == "proxy"
    assert service["kind"] == "Service" and cron["spec"]["schedule"] == "0 1 * * *" and job["metadata"]["name"] == "{{ .Release.Name }}"
    assert documents("") == documents("---\n---\n# x\n") == [] and documents("a: &x {b: c}\nd: *x") == [{"a": {"b": "c"}, "d": "*x"}]
    assert documents("- - a\n  - b\n- c") == [[["a", "b"], "c"]]
    assert documents("a:\n- 1\n- 2\nb: >\n  x\n  y\nc: ''") == [{"a": ["1", "2"], "b": "x y", "c": ""}]
    assert documents("a: 1\n   b: odd\nc: 2") == [{"a": "1", "c": "2"}]


def frame(spark, files):
    return spark.createDataFrame([("r", p, c) for p, c in files], "repo string, path string, content string")


def test_rows(spark):
    files = [("deploy/k8s/a.yaml", OBJECTS), ("docker-compose.yml", COMPOSE), ("config/a.yaml", OBJECTS), ("k8s/b.yml", None), ("k8s/c.yml", ": : [\n- {\n\t-"), ("k8s/d.yml", "")]
    got = [(r.path, r.document, r.kind, r.name, r.container, r.image, list(r.env), list(r.ports)) for r in deployments(frame(spark, files)).orderBy("path", "document", "name", "container").collect()]
    assert got == [
        ("deploy/k8s/a.yaml", 0, "Deployment", "cart-api", "api", "registry/cart:1.2", ["DB_URL", "MODE"], [8080, 9090]), ("deploy/k8s/a.yaml", 0, "Deployment", "cart-api", "proxy", "sidecar", [], []),
        ("deploy/k8s/a.yaml", 2, "CronJob", "nightly", "job", "tool", [], []), ("docker-compose.yml", 0, "service", "db", "db", None, ["C", "D"], [5432]), ("docker-compose.yml", 0, "service", "web", "web", "web:1", ["A", "B"], [8080, 8443]),
    ]


def test_names(spark):
    files = [("k8s/a.yaml", OBJECTS), ("compose.yaml", COMPOSE), ("chart/Chart.yaml", "apiVersion: v2\nname: 'shop'\n"), ("serverless.yml", "service: fn\nprovider: x"), ("Dockerfile", "FROM a\nLABEL app=\"img\" x=y"), ("Dockerfile.dev", "FROM a"), ("a.yaml", "name: no")]
    assert {(r.path, r.service) for r in deployed_as(frame(spark, files)).collect()} == {("k8s/a.yaml", "cart-api"), ("k8s/a.yaml", "nightly"), ("compose.yaml", "web"), ("compose.yaml", "db"), ("chart/Chart.yaml", "shop"), ("serverless.yml", "fn"), ("Dockerfile", "img")}
