"""Fixed values of the graph rules: word lists, closed sets and tables, in their natural order."""

FORBIDDEN_UI_WORDS = "click tap swipe hover scroll drag drop toggle button dropdown modal dialog popup panel checkbox radio slider tooltip menu sidebar navbar tab icon postback gridview".split()
INPUT_VERBS = "enter input provide specify select choose indicate set designate capture mark toggle pick filter".split()
NETWORK_VERBS = "submit generate upload download delete save send fetch retrieve publish persist sync import export share subscribe unsubscribe authenticate authorize refresh poll".split()
SIDE_EFFECT_VERBS = "receive publish consume send submit persist save insert update delete index upload download fetch query execute push pull forward notify invoke call resolve retrieve sync import export write generate".split()
SYSTEM_PERSONAS = ["system", "external system"]
FORBIDDEN_PERSONA_NAMES = "developer engineer programmer architect api service component module worker backend frontend database controller handler repository devops verticle filter webappengine engine".split()
IDENTIFIER_PATTERNS = [r"\bRepository\b", r"\btable\b", r"\bentity\b", r"\bindex\b", r"\bbucket\b", r"\bcollection\b", "s3://", "sqs://", "kafka://", "rabbit://", "->", "→"]
MODALITIES = "WEB MOBILE TABLET DESKTOP VOICE API KIOSK WATCH TV".split()
PAGE_TYPES = "LIST DETAIL FORM DASHBOARD".split()
COMPONENT_TYPES = "ATOM MOLECULE ORGANISM TEMPLATE".split()
LAYOUT_TYPES = "GRID FLEX SIDEBAR FULL".split()
EXPECTED_TEMPLATES = {"FORM": "FormPageLayout", "LIST": "ListPageLayout", "DETAIL": "DetailPageLayout", "DASHBOARD": "DashboardLayout"}
MIN_SUPPORTING = {"TEMPLATE": 2, "ORGANISM": 2, "MOLECULE": 2, "ATOM": 0}
SYNONYMS = [
    ("login", "signin"), ("login", "sign-in"), ("signin", "sign-in"), ("logout", "signout"), ("logout", "sign-out"), ("signout", "sign-out"),
    ("register", "signup"), ("register", "sign-up"), ("signup", "sign-up"), ("search", "find"), ("delete", "remove"), ("edit", "modify"), ("edit", "update"),
    ("list", "table"), ("detail", "details"), ("detail", "view"), ("form", "input"), ("dialog", "modal"), ("drawer", "panel"), ("btn", "button"),
    ("nav", "navigation"), ("img", "image"), ("pwd", "password"), ("auth", "authentication"), ("config", "configuration"), ("info", "information"),
]
PLACEHOLDER_DESCRIPTIONS = ["n/a", "na", "tbd", "todo", "-", ".", "none", "skip", "description", "desc", "placeholder"]
IN_FLIGHT = ["started", "node_creation", "relationship_creation", "creating_embeddings", "metadata_addition"]
SUPPORTED_EXTENSIONS = ".cs .vb .java .py .ts .tsx .js .jsx .mjs .cjs .html .htm .cshtml .razor .aspx .ascx .master .vue".split()
SUPPORTED_LANGUAGES = ["C#", "Java", "Python", "TypeScript", "JavaScript", "VB"]
DEFAULT_IGNORES = (
    ".git/ .svn/ .hg/ node_modules/ vendor/ bower_components/ jspm_packages/ package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml bun.lockb "
    "__pycache__/ *.pyc *.pyo .venv/ venv/ .tox/ .mypy_cache/ .pytest_cache/ .ruff_cache/ *.egg-info/ dist/ build/ out/ target/ bin/ obj/ .next/ .nuxt/ "
    ".svelte-kit/ *.min.js *.min.css .cache/ .parcel-cache/ .gradle/ .idea/ .vscode/ .env .env.* *.pem *.key id_rsa* *.log logs/ tmp/ temp/ *.tfstate "
    "*.tfstate.backup .terraform.lock.hcl test/ tests/ __tests__/ *.test.* *.spec.* test_*.py *_test.py *_test.go"
).split()
OUTBOUND_VERBS = ["call", "invoke", "publish", "send"]
INBOUND_VERBS = ["receive", "consume", "handle"]
#: A route, a broker address or a schedule that a text spells out.
ROUTE_TOKEN = (
    r"(?i)(?:\b(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+/\S+)"
    r"|(?:\b(?:https?|sqs|sns|kafka|rabbit|amqp|servicebus|pubsub|grpc|wss?|s3)://\S+)"
    r"|(?:\bcron:\S+)"
    r"|(?:(?:^|\s)/(?:api|internal|admin|webhooks?|graphql|v\d+)\b[\w\-./{}:]*)"
)
# Elements and attributes of user interfaces in source text, in the order of the rule; each counts for itself.
WIDGET_PATTERNS = [
    r"<Button\b", r"<IconButton\b", r"<Input\b", r"<TextField\b", r"<TextArea\b", r"<Textarea\b", r"<Select\b", r"<MenuItem\b", r"<Checkbox\b", r"<Switch\b", r"<Toggle\b", r"<Radio\b",
    r"<Autocomplete\b", r"<DatePicker\b", r"<TimePicker\b", r"<Slider\b", r"<Tabs\b", r"<Stepper\b", r"<Dialog\b", r"<Drawer\b", r"<Sheet\b", r"<Popover\b", r"<DropdownMenu\b", r"<ContextMenu\b", r"<Form\b",
    r"<mat-button\b", r"<mat-raised-button\b", r"<mat-icon-button\b", r"<mat-fab\b", r"<mat-mini-fab\b", r"<mat-form-field\b", r"<mat-input\b", r"<mat-select\b", r"<mat-option\b", r"<mat-checkbox\b",
    r"<mat-radio-button\b", r"<mat-radio-group\b", r"<mat-slide-toggle\b", r"<mat-slider\b", r"<mat-autocomplete\b", r"<mat-datepicker\b", r"<mat-dialog\b", r"<mat-dialog-content\b",
    r"<mat-sidenav\b", r"<mat-drawer\b", r"<mat-tab-group\b", r"<mat-tab\b", r"<mat-stepper\b", r"<mat-menu\b", r"<mat-menu-item\b", r"<mat-card\b", r"<mat-expansion-panel\b", r"<mat-chip\b",
    r"<mat-paginator\b", r"<mat-sort-header\b", r"<mat-table\b",
    r"\(click\)=", r"\(ngSubmit\)=", r"\(change\)=", r"\(input\)=", r"\(selectionChange\)=", r"\[formGroup\]", r"\[formControl\]", "formControlName=", r"\[\(ngModel\)\]", r"\[routerLink\]", "routerLink=",
    r"<button\s+mat-", r"<a\s+mat-",
]
#: Of node rows: names that no persona has, and phrases that no outcome holds.
FORBIDDEN_NODE_PERSONAS = "developer engineer programmer api service component module backend frontend database controller handler repository".split()
TECHNICAL_OUTCOMES = ["handle api", "process database", "render component", "execute query"]
#: Statements that branch, and what they or queries name where they matter.
BRANCH_TYPES = ["if_statement", "elif_clause", "else_clause", "conditional_expression"]
BRANCH_WORDS = [
    "flag", "type", "mode", "status", "role", "kind", "category", "inout", "csflag", "gsflag", "icflag", "avflag", "maflag", "request_param", "request.params", "request.matchdict",
    "query.type", "query.mode", "wftype", "wf_type", "== 9", "== 3", "== 15", "== 19", "== 4", "== 16", "'sale'", "'purchase'", "'receipt'", "'payment'", '"sale"', '"purchase"', '"receipt"', '"payment"',
]
ROUTE_WORDS = ["request_param", "request_method"]
QUERY_WORDS = "invoice voucher delchal purchaseorder transfernote rejectionnote customerandsupplier product godown stock tax bankrecon drcr budget project insert update delete create where".split()
#: Resource types by layer: beginnings of names, and endings where the middle is free. The last list is also flagged for a look.
RESOURCE_LAYERS = {
    "EventQueue": "aws_sqs_queue aws_sns_topic aws_msk_cluster aws_kinesis_stream aws_kinesis_firehose aws_mq_broker google_pubsub_ azurerm_servicebus_ azurerm_eventhub_",
    "DataLake": "aws_rds_ aws_db_instance aws_aurora_ aws_dynamodb_table aws_elasticache_ aws_redshift_ aws_opensearch_domain aws_s3_bucket aws_timestream_ aws_glue_ aws_emr_ google_sql_ google_bigtable_ google_bigquery_ google_storage_bucket azurerm_cosmosdb_ azurerm_*_database azurerm_storage_account azurerm_synapse_",
    "ApiGateway": "aws_api_gateway_ aws_apigatewayv2_ aws_lb aws_alb aws_appsync_ google_api_gateway_ google_compute_*_load_balancer azurerm_api_management azurerm_application_gateway kubernetes_ingress",
    "Services": "aws_lambda_function aws_ecs_service aws_ecs_task_definition aws_apprunner_service google_cloud_run_ google_cloudfunctions_ azurerm_function_app azurerm_container_app kubernetes_deployment kubernetes_stateful_set helm_release",
    "Infrastructure": "aws_eks_cluster aws_eks_node_group aws_ecs_cluster aws_vpc aws_subnet aws_autoscaling_group aws_cloudfront_distribution aws_route53_ aws_instance aws_elb google_container_cluster google_compute_network azurerm_kubernetes_cluster azurerm_virtual_network",
    "ObservabilityMonitoring": "aws_cloudwatch_ aws_xray_ aws_prometheus_ aws_grafana_ google_monitoring_ azurerm_monitor_ azurerm_application_insights",
    "UserExperience": "aws_amplify_",
}
FLAGGED_RESOURCES = {"DataLake": "aws_sagemaker_ aws_bedrock_ google_vertex_ai_ azurerm_cognitive_ azurerm_machine_learning_"}
#: Texts that mark an intent as not functional.
NON_FUNCTIONAL = [
    "Test ", "Mock ", "Benchmark", "Initialize ", "Establish ", "Run Service Initialization", "Register API Handlers", "Start Application", "Start Web Server",
    "Start Moderation Service", "Database Migration", "Database Connection", "Connect to ", "Vite", "Frontend Build", "Development Environment",
    "Configure Frontend Environment", "Configure GRPC", "Configure gRPC", "Configure Application Router", "Configure Server Router", "Configure Service Router",
    "Configure Logging", "Render Loading", "Render Skeleton", "Render Fallback", "Render Tooltip", "Render Error Boundary", "Render Spinner", "Re-render Component",
    "Font Rendering", "Font Metric", "Font Loading", "Parse SVG Path", "Transform SVG Coordinates", "Skeleton Loading", "Loading Spinner", "Loading Fallback",
    "Error Boundary", "State Management", "Context Provider", "Event Handler", "Event Listener", "Debounce ", "Throttle ", "Webpack", "Docker", "Nginx", "CI/CD",
    "Pipeline Configuration", "Environment Variable", "Health Check Endpoint", "CORS Configuration",
]

# Words on which personas overlap, in the order of the rule.
OVERLAP_KEYWORDS = ["bond", "static data", "price", "fx", "p&l", "expense", "pdf", "audit", "exception", "waiv", "tolerance", "upload", "report", "dashboard", "validation"]

# What a change set leaves out (project.json stays), style and asset files, and components that keep these.
CHANGE_IGNORES = (
    "*.md *.txt *.json *.yml *.yaml *.lock *.log node_modules/ dist/ build/ .git/ .vscode/ .idea/ __pycache__/ *.test.* *.spec.* *_test.* *_spec.* "
    ".env* Dockerfile docker-compose* Makefile azure-pipelines/ scripts/ tools/ docs/ e2e/"
).split()
STYLE_FILES = "*.css *.scss *.less *.svg *.png *.jpg".split()
COMPONENT_FILES = "*.tsx *.jsx *.vue *.svelte *.component.ts *.component.html".split()

# Signals of a path in a repository without workspaces.
FRONTEND_FOLDERS = "src/pages src/views src/components src/app pages views components".split()
FRONTEND_FILES = "*.tsx *.jsx *.vue *.svelte *.cshtml *.aspx *.html".split()
BACKEND_FOLDERS = "controllers resolvers services routes handlers consumers processors jobs middleware".split()
BACKEND_FILES = "*.controller.ts *.service.ts *.resolver.ts *Controller.cs *Controller.java views.py routes.py".split()

# Files that mark a workspace; its type by path (pattern, type, framework), then by what lies in it (patterns, type, framework).
WORKSPACE_MARKERS = "package.json project.json angular.json".split()
WORKSPACE_TYPES = [
    ("apps/*/web", "frontend", "detect"), ("apps/*/syndication", "frontend", "detect"), ("apps/*/api", "backend", "detect"), ("apps/lambda", "backend", "lambda"), ("apps/*/sitemap-lambda", "backend", "lambda"),
    ("libs/ngx-*", "shared-frontend", "angular"), ("libs/nest-*", "shared-backend", "nestjs"), ("libs/express-*", "shared-backend", "express"), ("libs/utils-node", "shared-backend", "node"),
    ("libs/opensearch-ops-common", "shared-backend", "other"), ("libs/*-index-structure", "shared-backend", "other"), ("libs/source-common", "shared-both", "other"), ("libs/utils-ts", "shared-both", "other"), ("libs/*-common", "shared-both", "other"),
]
WORKSPACE_SIGNS = [
    (["**/src/app/", "*.component.ts", "*.component.html"], "frontend", "angular"), (["*.controller.ts", "*.service.ts", "*.module.ts"], "backend", "nestjs"), (["handler.ts", "bootstrap.ts"], "backend", "lambda"),
]
