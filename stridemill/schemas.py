"""Record schemas. Flat tables are the working form; nested records only cross the JSON boundary."""

STEP = (
    "run_id string, task_id string, env string, goal string, t long, observation string, action string, "
    "reward double, done boolean, info string, pos long"
)

NESTED_STEP = "struct<t:bigint,observation:string,action:string,reward:double,done:boolean,info:string>"

TRAJECTORY = (
    "task_id string, env string, goal string, success boolean, final_reward double, "
    f"steps array<{NESTED_STEP}>, token_cost long, latency_sec double"
)

SEGMENT_METADATA = (
    "struct<trajectory_id:string,env:string,goal:string,trajectory_success:boolean,final_reward:double,"
    "step_reward:double,done:boolean,action:string>"
)

NESTED_SEGMENT = f"struct<segment_id:string,label:string,step_index:bigint,text:string,metadata:{SEGMENT_METADATA}>"

SEGMENT_RECORD = f"segment_id string, label string, step_index long, text string, metadata {SEGMENT_METADATA}"

RECORD = (
    "task_id string, env string, goal string, success boolean, final_reward double, "
    f"steps array<{NESTED_STEP}>, segments array<{NESTED_SEGMENT}>"
)

COUNTER = "array<struct<value:string,count:bigint>>"

SKILL_METADATA = (
    "struct<support:double,coverage:double,success_rate:double,failure_rate:double,avg_reward:double,"
    "avg_step_reward:double,recent_success_rate:double,recent_reward_lift:double,token_cost:double,"
    f"labels:{COUNTER},action_templates:{COUNTER},trajectory_count:bigint,source_method:string,"
    "tower_level:string,child_skill_ids:array<string>,deployment_utility:double,deployment_weight:double,"
    "refinement_action:string>"
)

MODEL_DOCUMENT = (
    "method string, description string, "
    "nodes array<struct<node_id:string,label:string,text:string,metadata:struct<"
    "node_type:string,granularity:string,refinement_action:string,historical_refinement_node:boolean,"
    "trajectory_id:string,env:string,goal:string,trajectory_success:boolean,final_reward:double,"
    "step_reward:double,done:boolean,action:string>>>, "
    "edges array<struct<source:string,target:string,relation:string,weight:double,metadata:struct<"
    "semantic:double,transition:double,outcome_consistency:double,contrastive_weight:double>>>, "
    "skills array<struct<skill_id:string,name:string,granularity:string,members:array<string>,"
    f"content:string,embedding_text:string,metadata:{SKILL_METADATA},first_member:bigint>>, "
    "metadata string, first_skill bigint, first_node bigint"
)

RETRIEVAL_RECORD = (
    "task_id string, step long, retrieved_skills array<struct<skill_id:string,granularity:string,"
    "metadata:struct<retrieval_score:double,retrieval_strategy:string>>>, "
    "retrieval_metadata struct<retrieval_strategy:string,candidate_skill_count:bigint,"
    "returned_skill_count:bigint,embedding_total_tokens:double>"
)

SKILLS = (
    "skill_id string, pos long, name string, granularity string, tower_level string, content string, "
    "embedding_text string, support long, coverage double, success_rate double, failure_rate double, "
    "avg_reward double, avg_step_reward double, recent_success_rate double, recent_reward_lift double, "
    f"token_cost long, trajectory_count long, labels {COUNTER}, action_templates {COUNTER}, "
    "source_method string, child_skill_ids array<string>, deployment_utility double, deployment_weight double, "
    "refinement_action string"
)

MEMBERS = "skill_id string, segment_id string, pos long"

NODES = (
    "node_id string, node_type string, granularity string, label string, text string, "
    "refinement_action string, historical boolean"
)

EDGES = (
    "source string, target string, relation string, weight double, semantic double, transition double, "
    "outcome_consistency double, contrastive_weight double"
)

SUMMARY = (
    "success_rate double, episodes long, avg_steps double, avg_reward double, invalid_action_rate double, "
    "loop_rate double, avg_token_cost double, avg_retrieval_embedding_token_cost double, "
    "avg_total_token_cost double, components map<string,string>, model_method string, skill_count long, "
    "deployment_model_method string, deployment_skill_count long, avg_retrieved_skills double, "
    "avg_deployment_retrieved_skills double"
)

SELECTOR_MEASURES = [
    "future_utility_pearson", "future_utility_spearman", "positive_utility_auc", "avg_selected_utility",
    "avg_oracle_utility", "regret", "positive_selection_rate", "avg_selected_token_cost",
]

_MEASURES = "struct<" + ",".join(f"{name}:double" for name in SELECTOR_MEASURES) + ">"

SELECTOR_METRICS = (
    "config string, records string, miner string, model_method string, split map<string,double>, top_k long, "
    f"selectors map<string,{_MEASURES}>, "
    "batches array<struct<batch_index:bigint,task_start:bigint,task_end:bigint,task_count:bigint,"
    f"selectors:map<string,{_MEASURES}>>>"
)

MODEL_SUMMARY = (
    "config string, model_dir string, model_path string, method string, skill_count long, segment_count long, "
    "avg_skill_token_cost double, total_skill_token_cost double, avg_skill_support double, "
    "avg_retrieved_skills double, avg_retrieval_embedding_token_cost double, official_output_path string"
)
